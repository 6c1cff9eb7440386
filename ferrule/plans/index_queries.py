"""Search by postings, and delimited files whose encoding and delimiter are told from their bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators.postings import Postings
from ferrule.plans.document_queries import _FLAT, _SPACED
from ferrule.registry import query
from ferrule.scratch import scratch_path
from ferrule.sources import sniff


def _index(t, kind: str):
    docs = t.documents.select("doc_id", "text")
    return docs, Postings(t.spark, scratch_path(t.spark, "postings")).build(docs, "doc_id", kinds=(kind,))


@query(f"""
SELECT doc_id, substr(text, greatest(1, instr({_FLAT}, ' the ') - 30), 200) AS snippet FROM documents
WHERE (contains({_SPACED}, ' the ') AND contains({_SPACED}, ' of the ')) OR contains({_SPACED}, ' moron ')""")
def postings_words(t):
    """Words, phrases and OR by postings with positions (TXT-01, TXT-05)."""
    docs, index = _index(t, "word")
    return index.words(docs, 'the "of the" OR moron', "doc_id").drop("text")


@query("SELECT doc_id, substr(text, greatest(1, instr(lower(text), 'thing') - 30), 200) AS snippet FROM documents WHERE contains(lower(text), 'thing')")
def postings_literal(t):
    """Literal search by trigrams (TXT-02, TXT-05)."""
    docs, index = _index(t, "gram")
    return index.literal(docs, "Thing", "doc_id").drop("text")


@query("""
SELECT 'É ' || s_name AS name, s_nationkey::VARCHAR AS nation, NULL AS more FROM supplier UNION ALL SELECT n_name || '; ü', n_nationkey::VARCHAR, NULL FROM nation UNION ALL SELECT r_name || ', €', r_regionkey::VARCHAR, 'x' FROM region""")
def sniffed_exports(t):
    """Exports in three encodings and with three delimiters, read together (SRC-04, SRC-10)."""
    root = scratch_path(t.spark, "exports")
    parts = [
        (t.supplier.select(F.concat(F.lit("É "), "s_name").alias("name"), F.col("s_nationkey").alias("nation")), ";", "ISO-8859-1"),
        (t.nation.select(F.concat("n_name", F.lit("; ü")).alias("name"), F.col("n_nationkey").alias("nation")), "\t", "UTF-16LE"),
        (t.region.select(F.col("r_regionkey").alias("nation"), F.concat("r_name", F.lit(", €")).alias("name"), F.lit("x").alias("more")), ",", "UTF-8"),
    ]
    for k, (df, sep, encoding) in enumerate(parts):
        df.write.options(header="true", sep=sep, encoding=encoding).csv(f"{root}/{k}")
    return sniff.read_delimited(t.spark, root, pattern="*.csv").drop("_path")
