"""The corpus pipeline: documents through five stages, each written and read again.

Language ID, near-duplicates, benchmark decontamination, secrets, token ids. A
stage works on all rows that its predecessor kept and its decisions take effect:

- ``language`` drops texts in no known language: ``und``, a best language less
  likely than all others together, or one that codes the text far worse than
  held-out texts of about its size in the known languages;
- ``near_dedup`` keeps one row, that of the smallest doc_id, of each group of linked
  fingerprints; rows with one id and unlinked texts all stay, as do rows without a
  doc_id;
- ``decontaminate`` drops texts that hold a benchmark window (of rows without a
  doc_id, all if any does);
- ``secrets`` replaces accepted findings inside the text and counts characters anew;
- ``tokens`` returns doc_id, lang, source, n_chars and the SentencePiece ids.

All but the last return the columns of ``documents``. An empty table passes
through all stages; null texts are in no known language and go first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomloom.llm import decontam, langid, secret_scan, simhash
from axiomloom.llm import sentencepiece as pieces
from axiomloom.session import cut_lineage

LEAST_POSTERIOR = 0.5
KNOWN_SHARE, MARGIN = 0.98, 1.5
MASK = "[SECRET]"


def _trains() -> Column:
    """The rows that the language model may learn; the others show what texts of known languages take."""
    return langid.held_out("doc_id", 2, 0)


def _most_bits(spark: SparkSession, docs: DataFrame, model: langid.Model) -> Column:
    """Bits a byte that a text in a learned language takes at most, by its size.

    From all labelled rows that the model was not trained on: MARGIN times the
    KNOWN_SHARE quantile of texts of at least about half the size. Without such
    rows there is no bound.
    """
    others = docs.filter(~_trains() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = lambda c: F.floor(F.log2(F.greatest(F.octet_length(c), F.lit(1)))).cast("int")
    known = langid.predict(others, model, keep=(size("text").alias("size"),))
    found = known.filter(F.col("lang_pred") != langid.UNKNOWN).groupBy("size").agg(
        F.percentile_approx("bits_per_byte", KNOWN_SHARE).alias("bits")).collect()  # a row per power of two
    most = F.lit(float("inf"))
    for r in sorted(found, reverse=True):
        bits = MARGIN * max(x.bits for x in found if x.size >= r.size)
        most = F.when(size("text") <= r.size + 1, bits).otherwise(most)
    longest = max((r.size for r in found), default=0)
    return F.when(size("text") > longest + 1, MARGIN * max(x.bits for x in found if x.size == longest)).otherwise(most) if found else most


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.filter(_trains()))
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    marked = langid.predict(docs, model, keep=(rest,), with_text=True)
    known = ((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR)
             & (F.col("bits_per_byte") <= _most_bits(spark, docs, model)))
    return marked.filter(known).select("row.*", "text").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = cut_lineage(simhash.linked(docs), "linked")
    later = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    again = cut_lineage(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    kept = docs.join(cut_lineage(later, "later-copies"), "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    # rows that share an id are told apart by their fingerprints: of each group, the smallest row of the id that names it
    rows = docs.join(again, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "text")
    own = groups.join(again, "doc_id", "left_semi").filter("doc_id = component_id").select(F.col("doc_id").alias("id"), "fp", "root").distinct()
    marked = simhash.fingerprints(rows, "text", "row").select(F.col("doc_id").alias("row"), "fp", F.col("doc_id.doc_id").alias("id"))
    first = marked.join(own, ["id", "fp"]).groupBy("id", "root").agg(F.min("row").alias("row"))
    return once.unionByName(first.select("row.*").select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = cut_lineage(decontam.decontaminate(docs, items).filter("contaminated").select("doc_id").distinct(), "hit-ids")
    clean = docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
    nameless = hit.filter("doc_id is null")  # rows without an id cannot be told apart: all go if any is hit
    return clean if nameless.isEmpty() else clean.filter("doc_id is not null")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("row")
    cleaned = secret_scan.scan(docs.select(rest, "text", "source"), secret_scan.learn(docs), keep=("row",), redact=MASK)
    n_chars = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return cleaned.select("row.*", F.col("redacted").alias("text"), n_chars.alias("n_chars")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = pieces.encode_documents(docs, pieces.read_model(), carry=("lang", "source", "n_chars"))
    return ids.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("bigint").alias("n_ids"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL can express neither the trained models nor the components; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
