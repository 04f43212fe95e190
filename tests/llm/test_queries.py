"""The registered queries over whole small tables: against their SQL where there is some, else against brute force."""

import os
import random
import sys
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

WORDS = "the of and to in a is that der die und la de et run fast slow blue cat sat mat dog über".split()


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """Tables with nulls, empty and very long texts, copies, near copies, benchmark passages and columns of clashing names."""
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n))
    base = [text(rng.randrange(1, 160)) for _ in range(50)]
    near = [" ".join(w if rng.random() > 0.02 else "edit" for w in rng.choice(base).split()) for _ in range(20)]
    odd = [None, "", " \n ", "a", "A b.\nA b.\n\nA b.", "x<|endoftext|>y #$%", "é, ÉÀ。日本 ς\u2003z\x0b", "word " * 20_000, text(15_000), "w" * 200_000, base[0], base[0], "one two three four five six seven eight nine ten eleven"]
    texts = [*base, *near, *odd]
    langs = [rng.choice(["en", "fr", "de", None, "xx"]) for _ in texts]
    folder = tmp_path_factory.mktemp("sf")
    put = lambda name, df: df.to_parquet(folder / f"{name}.parquet", index=False)
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": langs, "source": "s", "n_chars": [len(t or "") for t in texts], "th": 1, "row": 2, "n_hit": 3, "shard": 4})
    put("documents", docs)
    put("benchmark", pd.DataFrame({"item_id": range(6), "text": ["two THREE four five six seven eight nine ten eleven x", "cat sat", None, "", base[3], base[3]]}))
    urls = [rng.choice(["http://a.net/x/1", "https://b.example.org/en/12?q=1", "http://EXAMPLE.org/es/", "http://spam.biz/buy/now?id=3&x", "http://www.com/de/", "http://c.net/buy/2#f", None, "nothing", "x://", "ftp://fr.com/fr/" + "y" * 5000]) for _ in range(300)]
    html = [rng.choice([None, "", "<p>one</p>", "<p>two é</p>", "z" * 300_000, str(rng.random())]) for _ in urls]
    put("pages", pd.DataFrame({"page_id": range(300), "url": urls, "html": html, "rule": 1, "verdict": "clash", "best": 2}))
    put("labels", pd.DataFrame({"doc_id": range(0, 300, 2), "quality": [0 if "buy" in (urls[i] or "") and rng.random() < 0.9 else 1 for i in range(0, 300, 2)], "toxic": 0}))
    turns = [(c, t, rng.choice(["user", "assistant", None, "a: b"]), rng.choice([None, "", "hi ### there", "</turn>\\\\", text(30), "é😀" * 3000])) for c in range(12) for t in range(rng.randrange(1, 9))]
    put("conversations", pd.DataFrame(turns + [(3, 50 + i, "user", f"turn {i}") for i in range(200)], columns=["conv_id", "turn", "role", "text"]).assign(part=1, ids="clash"))
    return str(folder), docs


def result(spark, sf, name):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, sf[0]).toPandas()


@pytest.mark.parametrize("name", ["op3_language_divergence", "op5_chat_tokens", "op6_warc_revisits", "op8_winnowing", "op9_bayesian_jaccard"])
def test_queries_with_sql(spark, sf, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf[0]}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = result(spark, sf, name)
    key = want.columns[0]
    a, b = (x[sorted(want.columns)].sort_values(key, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6)


def whole(name, texts, end):
    from tokenizers import Tokenizer

    from simgrove.llm.tokens import vocabulary

    tok = Tokenizer.from_file(vocabulary(name))
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_op1(spark, sf):
    got = result(spark, sf, "op1_repair").sort_values("doc_id")
    ids = whole("word_bpe_49k.json", sf[1]["text"], 2)
    size = np.array(list(map(len, ids)))
    assert got["n_tokens"].tolist() == size.tolist() and got["start"].tolist() == (np.cumsum(size) - size).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def pieces_are_right(got, ids):
    for doc, own in got.sort_values("start").groupby("doc_id"):
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() == len(ids[doc])
        assert (own["doc_tokens"] == len(ids[doc])).all()
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[doc][s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= got["length"].sum() / 1024 + 3


def test_op4(spark, sf):
    got = result(spark, sf, "op4_best_fit_decreasing")
    assert set(got["doc_id"]) == set(sf[1]["doc_id"])
    pieces_are_right(got, dict(enumerate(whole("byte_bpe_50k.json", sf[1]["text"], 0))))


def test_op2(spark, sf):
    from simgrove.llm import url_rules as U

    pages, labels = pd.read_parquet(f"{sf[0]}/pages.parquet"), pd.read_parquet(f"{sf[0]}/labels.parquet")
    want = brute.url_verdicts(list(zip(pages["page_id"], pages["url"], strict=True)), labels.to_records(index=False).tolist(), U.PREFIX_RULES, U.MIN_SUPPORT, U.MIN_CONFIDENCE, U.DEFAULT)
    got = result(spark, sf, "op2_association_rules")
    assert len(got) == len(pages) and set(got["verdict"]) == {"allow", "block"}
    for r in got.itertuples():
        host, path, rule, verdicts = want[r.page_id]
        assert (r.host, r.path, r.rule if isinstance(r.rule, str) else None) == (host, path, rule) and r.verdict in verdicts


def test_op7(spark, sf):
    want = brute.kneser_ney(list(zip(sf[1]["doc_id"], sf[1]["text"], strict=True)))
    got = result(spark, sf, "op7_kneser_ney")
    assert len(got) == len(want)
    for r in got.itertuples():
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert np.isclose(r.base_score, base, rtol=1e-9) and np.isclose(r.score, score, rtol=1e-9)


def test_op10(spark, sf):
    from simgrove.llm import sharding as H

    got = result(spark, sf, "op10_weighted_hash_tree").sort_values("doc_id")
    raw = [(t or "").encode() for t in sf[1]["text"]]
    assert got["size"].tolist() == [len(x) + 1 for x in raw] and got["text_crc32"].tolist() == list(map(zlib.crc32, raw))
    for column, n in (("shard", 16), ("grown_shard", 17)):
        assert got[column].tolist() == [brute.shard_of(d, H.topology(n)) for d in got["doc_id"]]
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in got.groupby("shard"))


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs, folder = spark.read.parquet(f"{sf[0]}/documents.parquet"), sf[0]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    import __spark_entry__ as entry

    good = con.sql(f"SELECT doc_id FROM ({entry.oracle_sql()['op3_language_divergence']}) WHERE kept").df()["doc_id"].tolist()
    texts = dict(zip(sf[1]["doc_id"], sf[1]["text"], strict=True))
    stages = dict(P.STAGES)
    kept = stages["quality rules"](spark, docs, folder)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(good)
    classes = brute.near_classes([(d, texts[d]) for d in good])
    left = sorted({c for c, _ in classes.values()})
    assert 0 < len(left) < len(good)
    bench = pd.read_parquet(f"{folder}/benchmark.parquet").to_records(index=False).tolist()
    clean = {d for d, *_, hit in brute.winnow([(d, texts[d]) for d in left], bench) if not hit}
    assert 0 < len(clean) < len(left)
    got = P.run(spark, folder)
    from pyspark.sql import functions as F

    got = got.withColumn("ids_crc32", F.crc32("ids")).drop("ids").toPandas()
    assert set(got["doc_id"]) == clean
    pieces_are_right(got, {d: x for d, x in enumerate(whole("byte_bpe_50k.json", sf[1]["text"], 0))})
    for name, stage in P.STAGES:  # no rows, at every stage
        assert stage(spark, docs.limit(0), folder).count() == 0, name
