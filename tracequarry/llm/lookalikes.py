"""Problem 10: one consistent form of texts that look the same.

DuckDB runs inside the Arrow partitions: embedded SQL composes (nfc_normalize), maps
single characters (translate), removes invisible ones (regexp_replace) and opens joined
forms. Spark then groups equal forms.

Defined results
* null texts have a null form and match nothing; blank texts (nothing visible) neither;
* equal texts are no pair; every document of either of two different texts with one form
  is paired with every document of the other, as p10_found asks for document ids;
* runs of white space keep their length; case, accents, raised and circled signs, dashes
  and words stay as they are.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.session import cut_lineage

#: Letters of other scripts that are drawn like a Latin one (fixed values).
LOOK_ALIKES = {
    "Cyrillic": ("аеорсухіјѕһԁԛԝѵӏАВЕКМНОРСТХУІЈЅԌԚԜӀёЁїЇ", "aeopcyxijshdqwvlABEKMHOPCTXYIJSGQWIëËïÏ"),
    "Greek": ("ονιαρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "oviapcjABEZHIKMNOPTYXCJ"),
    "Armenian": ("օսոցհՕՍ", "ounghOU"),
    "Latin": ("ɡıɑſȷɩ", "giasji"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ", "ABCDEGHJKLMPRSTVWZ"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
}
#: Hyphens drawn like the plain one (fixed values).
HYPHENS = "‐‑﹣－"
#: Classes of Unicode decompositions that only change width, joining or spacing.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Joined Latin, Armenian letters: blocks and single signs whose <compat> decomposition is a ligature.
LIGATURES = [*range(0xFB00, 0xFB18), 0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3, 0x587]
#: Invisible characters, as an RE2 class.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
BLANK = r"^[\s\p{Z}\x{2800}]*$"


@functools.lru_cache(maxsize=1)
def mapping() -> tuple[str, str, list[tuple[str, str]]]:
    """(from, to, joined): single characters for translate, and longer forms, from Unicode's own data."""
    single: dict[str, str] = {}
    joined: dict[str, str] = {}

    def add(c: str, form: str) -> None:
        if c != form:
            (single if len(form) == 1 else joined)[c] = form

    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) == "Zs":
            add(c, " ")
        elif unicodedata.decomposition(c).split(" ")[0] in SAME_LOOK or code in LIGATURES:
            add(c, unicodedata.normalize("NFKC", c))
    for letters, latin in LOOK_ALIKES.values():
        for c, form in zip(letters, latin, strict=True):
            add(c, form)
    for c in HYPHENS:
        single[c] = "-"
    for c, form in list(single.items()):  # wide forms of letters that have a look-alike
        single[c] = single.get(form, form)
    return "".join(single), "".join(single.values()), sorted(joined.items())


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.lru_cache(maxsize=1)
def canonical_sql() -> str:
    """The embedded SQL over a table t(doc_id, text)."""
    source, target, joined = mapping()
    form = f"regexp_replace(text, '{INVISIBLE}', '', 'g')"
    form = f"nfc_normalize(translate(nfc_normalize({form}), {_quoted(source)}, {_quoted(target)}))"
    opened = form
    for c, parts in joined:
        opened = f"replace({opened}, {_quoted(c)}, {_quoted(parts)})"
    some = "[" + "".join(c for c, _ in joined) + "]"
    # joined forms are rare; only texts with one go through the long chain. A second pass catches marks that follow a mapped letter.
    return f"""
        WITH once AS (SELECT doc_id, text, {form} AS f FROM t),
        open AS (SELECT doc_id, text, CASE WHEN regexp_matches(f, {_quoted(some)}) THEN {opened.replace(form, "f")} ELSE f END AS f FROM once)
        SELECT doc_id, text, nfc_normalize(translate(f, {_quoted(source)}, {_quoted(target)})) AS form FROM open"""


def canonical_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text, form): the consistent form of every text; ASCII texts are their own form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1})
        sql = canonical_sql()
        for batch in batches:
            db.register("t", pa.Table.from_batches([batch]))
            out = db.sql(sql).to_arrow_table()
            db.unregister("t")
            yield from out.cast(SCHEMA).to_batches()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, form string")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("form", pa.string())])


def _hashed(documents: DataFrame) -> DataFrame:
    """(doc_id, form, text) of texts with something visible; hashes of 128 bits stand for form and text.

    Some forty bytes a document, written once, as several joins read them.
    """
    forms = canonical_texts(documents).where(F.col("form").isNotNull() & ~F.col("form").rlike(BLANK))
    digest = lambda c: F.unhex(F.md5(c))
    return cut_lineage(forms.select("doc_id", digest("form").alias("form"), digest("text").alias("text")))


#: Parts that the documents of one text are split into where texts meet documents.
SALTS = 16
#: A form with more than this share of all documents is joined by broadcast: there are fewer than 1 / HOT of them.
HOT = 0.001


def same_look_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_documents, n_texts): every document with the least doc_id of its form.

    A form may hold a third of all documents. Classes of such forms, fewer than 1 / HOT,
    are broadcast; the other documents meet their class by its hash.
    """
    rows = _hashed(documents)
    texts = rows.groupBy("form", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = cut_lineage(texts.groupBy("form").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_documents"), F.count("*").alias("n_texts")))
    least = HOT * rows.count()
    hot = F.broadcast(classes.where(F.col("n_documents") > least).withColumnsRenamed({"class_id": "c", "n_documents": "nd", "n_texts": "nt"}))
    met = rows.join(hot, "form", "left")
    names = ["doc_id", "class_id", "n_documents", "n_texts"]
    few = met.where("c is null").select("doc_id", "form").join(classes.where(F.col("n_documents") <= least), "form").select(*names)
    return met.where("c is not null").select("doc_id", F.col("c").alias("class_id"), F.col("nd").alias("n_documents"), F.col("nt").alias("n_texts")).unionByName(few)


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """p10_found: (doc_id_a, doc_id_b), different texts of one form.

    Forms are compared by their distinct texts, whatever their copies: only forms with two
    or more different texts go on. Each pair of texts then meets the documents of either
    text, which are split into SALTS parts, as one text may have very many copies.
    """
    rows = _hashed(documents)
    texts = rows.select("form", "text").distinct()
    mixed = texts.groupBy("form").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("form")
    kept = texts.join(mixed, "form", "left_semi")
    pairs = kept.select("form", F.col("text").alias("text_a")).join(kept.select("form", F.col("text").alias("text_b")), "form").where("text_a < text_b").select("text_a", "text_b")
    docs = rows.select("text", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = lambda df: df.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    side = lambda t, name: docs.select(F.col("text").alias(t), "salt", F.col("doc_id").alias(name))
    left = salted(pairs).join(side("text_a", "a"), ["text_a", "salt"]).drop("salt")
    both = salted(left).join(side("text_b", "b"), ["text_b", "salt"])
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()
