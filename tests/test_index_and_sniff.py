"""The optional index gives the rows of the scan; encodings and delimiters are told from bytes."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from ferrule.functions.text import word_position
from ferrule.operators import search
from ferrule.operators.postings import Postings
from ferrule.sources import dictionary, sniff

TEXTS = [(1, "The cat of the hat; THE end."), (2, "of the the of"), (3, None), (4, ""), (5, "a b a b c x_y"), (6, "Élan the OF"), (None, "the cat"), (7, "b a c"), (8, "over the Thingamabob")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    return docs, Postings(spark, str(tmp_path_factory.mktemp("index"))).build(docs, "id")


@pytest.mark.parametrize("query", ['the "of the" OR moron', "a", '"a b c"', '"b a b"', '"the the"', "cat hat", "nothing", "x_y OR élan", "", '"a b a b" c'])
def test_words(index, query):
    docs, postings = index
    docs = docs.where("id is not null")
    assert sorted(map(tuple, postings.words(docs, query, "id").collect())) == sorted(map(tuple, search.grep_words(docs, query).collect()))


def test_postings_leave_in_parts(monkeypatch):
    import pandas as pd

    from ferrule.operators import postings

    monkeypatch.setattr(postings, "ROWS", 20)
    texts = pd.DataFrame({"id": range(50), "text": ["the cat the hat"] * 50})
    made = list(postings._terms(iter([texts])))
    assert max(map(len, made)) <= 40 and sum(map(len, made)) == 50 * (3 + len({"the cat the hat"[k : k + 3] for k in range(13)}))


@pytest.mark.parametrize("query", ['the "of the" OR moron', '"the the"', "a_b"])
def test_words_are_met_without_rewriting_texts(spark, query):
    texts = ["the of the", "  of\tthe-", "of_the", "OF, the!", "bathe of", "moron", "the the", "thethe the", "\U0001f600 the the", "é the. the", "a_b the", "xa_b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = search.grep_words(docs, query)
    spaced, flat = (F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), p, " "), F.lit(" ")) for p in ("[^a-z0-9_]+", "[^a-z0-9_]"))
    hit = lambda ps: reduce(lambda a, b: a & b, [spaced.contains(" " + " ".join(p) + " ") for p in ps])
    asked = search.parse_query(query)
    want = docs.where(reduce(lambda a, b: a | b, map(hit, asked))).select("id", F.instr(flat, f" {asked[0][0][0]} ").alias("at"))
    got = docs.where(search.words_match(F.col("text"), query)).select("id", word_position(F.col("text"), asked[0][0][0]).alias("at"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != [] and "regexp_replace" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("needle", ["the", "THE end", "ÉLAN", "zz", "b a c", "Thing", "; t"])
def test_literals(index, needle):
    docs, postings = index
    docs = docs.where("id is not null")
    for case in (True, False):
        assert sorted(map(tuple, postings.literal(docs, needle, "id", case_sensitive=case).collect())) == sorted(map(tuple, search.grep_literal(docs, needle, case_sensitive=case).collect()))
    assert sorted(map(tuple, postings.identifier(docs, needle, "id").collect())) == sorted(map(tuple, search.grep_identifier(docs, needle).collect()))


def test_only_parts_are_read(index):
    docs, postings = index
    plan = postings._of("word", ["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "part#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "EqualTo(term,cat)" in plan.replace("In(term, [cat])", "EqualTo(term,cat)")


def test_sniffing(spark, tmp_path):
    files = {
        "a.csv": "X3_ARQUIVO;X3_CAMPO\nSA1;É1\n".encode("cp1252"),
        "b.csv": "X3_ARQUIVO;X3_CAMPO\nSA2;É2\n".encode("cp1252"),
        "c.csv": "﻿X3_ARQUIVO,X3_CAMPO,MORE\nSA3,\"É,3\",m\n".encode(),
        "d.csv": "X3_CAMPO\t\"X3_ARQUIVO,;\"\nÉ4\tSA4\n".encode("utf-16-le"),
        "e.csv": b"",
        "f.csv": ("X3_ARQUIVO|X3_CAMPO\n" + "SA5|" + "é" * 4000 + "\n").encode(),
        "g.csv": b"X3_ARQUIVO,X3_CAMPO\nSA6,plain\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.sep) for r in sniff.sniffed(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ("cp1252", ";"), "b.csv": ("cp1252", ";"), "c.csv": ("utf-8-bom", ","), "d.csv": ("utf-16le", "\t"), "f.csv": ("utf-8", "|"), "g.csv": ("ascii", ",")}
    rows = sniff.read_delimited(spark, str(tmp_path))
    assert sorted((r.X3_ARQUIVO or r["X3_ARQUIVO,;"], r.X3_CAMPO[:3], r.MORE) for r in rows.collect()) == [("SA1", "É1", None), ("SA2", "É2", None), ("SA3", "É,3", "m"), ("SA4", "É4", None), ("SA5", "ééé", None), ("SA6", "pla", None)]
    (tmp_path / "h.csv").write_bytes(b"PK\x03\x04rest")
    with pytest.raises(ValueError):
        sniff.read_delimited(spark, str(tmp_path))
    (tmp_path / "none").mkdir()


def test_dictionary_in_another_encoding(spark, tmp_path):
    (tmp_path / "sx2.csv").write_bytes("X2_CHAVE;X2_NOME\nSA1;Clientes é\n".encode("cp1252"))
    loaded = dictionary.load(spark, str(tmp_path))
    assert "é" in str(loaded["sx2"].collect())


def test_an_index_of_one_kind(spark, tmp_path):
    """a search for words built all trigrams too, two thirds of the postings; what an index lacks is searched by a scan."""
    docs = spark.createDataFrame(TEXTS, "id long, text string").where("id is not null")
    for kind, other in (("word", "gram"), ("gram", "word")):
        built = Postings(spark, str(tmp_path / kind)).build(docs, "id", kinds=(kind,))
        assert (tmp_path / kind / f"kind={kind}").is_dir() and not (tmp_path / kind / f"kind={other}").exists()
        for again in (built, Postings(spark, str(tmp_path / kind))):
            assert sorted(map(tuple, again.words(docs, '"of the"', "id").collect())) == sorted(map(tuple, search.grep_words(docs, '"of the"').collect())) != []
            assert sorted(map(tuple, again.literal(docs, "The", "id").collect())) == sorted(map(tuple, search.grep_literal(docs, "The").collect())) != []
