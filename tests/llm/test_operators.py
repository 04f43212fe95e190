"""Each operator against brute force, round trips, and the awkward cases: nulls, empties, ties, repeats, clashing names."""

import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

WORDS = "the of cat sat mat dog é über run fast slow blue".split()
ODD = [(1, None), (2, ""), (3, " \n "), (4, "a"), (4, "a"), (None, "a b"), (5, "x " * 3000), (6, "a b c d e f g h i j k l")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def texts(n, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 90))) for _ in range(n // 2)]
    near = [" ".join(w if rng.random() > 0.03 else "edit" for w in rng.choice(base).split()) for _ in range(n - len(base))]
    return [(i, t) for i, t in enumerate(base + near)]


def test_repair(spark, tmp_path):
    from simgrove.llm import repair as R

    rows = sorted([*texts(60, 1), *[(100 + i, t) for i, (_, t) in enumerate(ODD)]])
    folder = R.write_ids(docs(spark, rows), str(tmp_path / "b"), R.vocabulary("word_bpe_49k.json"), shards=3)
    got = sorted(tuple(r) for r in R.read_ids(spark, folder).collect())
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(R.vocabulary("word_bpe_49k.json")), 0
    for (d, t), g in zip(rows, got, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert g == (d, start, len(ids), ids.tobytes())
        start += len(ids)
    assert R.read_ids(spark, R.write_ids(docs(spark, rows).limit(0), str(tmp_path / "e"), R.vocabulary("word_bpe_49k.json"))).count() == 0


def test_repair_fetch(spark, tmp_path):
    from tokenizers import Tokenizer

    from simgrove.llm import repair as R

    path = R.vocabulary("word_bpe_49k.json")
    rows = [*texts(40, 6), (7, "a second text with this id"), (None, "no id"), (99, "copy of one text " * 2000)]
    folder = R.write_ids(docs(spark, rows), str(tmp_path / "f"), path, shards=3)
    tok = Tokenizer.from_file(path)
    want = {d: sorted(tok.encode(t, add_special_tokens=False).ids + [2] for k, t in rows if k == d) for d in (7, 12, 99, 500)}
    for d, (a, b) in ((7, (0, None)), (12, (3, 9)), (99, (4000, 4010)), (500, (0, None))):
        got = sorted(np.frombuffer(r.ids, "<u4").tolist() for r in R.fetch(spark, folder, d, a, b).collect())
        assert got == sorted(x[a:b] for x in want[d])


def test_repair_ends_when_no_pair_repays_its_rule():
    from simgrove.llm import repair as R

    rng = np.random.default_rng(5)
    text = rng.integers(0, 900, 300)
    for ids in (np.tile(text, 60), np.full(5000, 7), rng.integers(0, 40, 30_000), np.concatenate([np.tile([1, 2, 3], 500), rng.integers(0, 5, 999)])):
        c = R.compress(ids.astype(np.uint32), np.array([len(ids)]))
        s = c["symbols"].astype(np.int64)
        uses = {}
        for i in range(len(s) - 1):  # the occurrences of each pair that don't overlap
            last, n = uses.get((s[i], s[i + 1]), (-2, 0))
            if i > last + 1:
                uses[s[i], s[i + 1]] = (i, n + 1)
        assert max(n for _, n in uses.values()) < R.LEAST_USES if uses else True
        assert (R.expand_all(c["symbols"], c["rules"], c["rounds"], c["lengths"]) == ids).all() and (R.expand(c["symbols"], c["rules"], c["rounds"]) == ids).all()


def test_repair_random_access():
    from simgrove.llm import repair as R

    rng = np.random.default_rng(0)
    for n in (0, 1, 30, 20000):
        ids, sizes = (rng.zipf(1.5, n) % 50).astype(np.uint32), rng.multinomial(n, np.ones(20) / 20)
        c = R.compress(ids, sizes)
        b = R.Block({k: v.tobytes() for k, v in c.items()} | {"doc_tokens": sizes.astype("<u4").tobytes()})
        at = np.concatenate([[0], np.cumsum(sizes)])
        assert (R.expand(b.symbols, b.rules, b.rounds) == ids).all()
        for k in range(20):
            assert (b.ids(k) == ids[at[k] : at[k + 1]]).all() and (b.ids(k, 3, 11) == ids[at[k] + 3 : min(at[k] + 11, at[k + 1])]).all()


def test_pieces_are_whole_texts():
    from simgrove.llm.tokens import PieceEncoder, vocabulary

    rng = random.Random(4)
    odd = ["", " ", "foo \n bar", "a<|endoftext|>b", "ΟΔΟΣ İx", "can't  's", "\x1c a\x85b", "日本語 テスト"] + ["".join(rng.choice(" \n\t\rab1.'sé́<|") for _ in range(rng.randrange(25))) for _ in range(500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = PieceEncoder(vocabulary(name))
        ids, sizes = e.encode(odd)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for k, t in enumerate(odd):
            assert ids[at[k] : at[k + 1]].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_operators_that_share_a_worker_keep_their_encoders_apart(spark):
    from simgrove.llm import chat as C
    from simgrove.llm import packing as P

    path = P.vocabulary("byte_bpe_50k.json")
    one = spark.createDataFrame([(1, 0, "user", "x<|endoftext|>y")], "conv_id long, turn long, role string, text string").coalesce(1)
    want = [87, 50256, 88, 0]
    for _ in range(3):
        assert C.read_back(C.chat_format(one, path), path).first().formatted_chars == len("### user: x<|endoftext|>y </turn>\n")
        rows = P.pack(docs(spark, [(i, "x<|endoftext|>y") for i in range(8)]), path).collect()
        assert all(np.frombuffer(r.ids, "<u4").tolist() == want for r in rows)


def test_url_rules(spark):
    from simgrove.llm import url_rules as U

    rows = [(i, f"http://{'spam' if i % 2 else 'ok'}.net/a/{i}?q=1") for i in range(40)] + [(100, None), (101, "no scheme"), (102, "http://A.Example.org/en/12?x#y"), (102, "http://A.Example.org/en/12?x#y"), (None, "https://x.com/fr/1"), (103, "http://notorg/"), (104, "x://org")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2 == 0, 0) for i in range(30)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic")
    got = {r.page_id: r for r in U.judge(spark, pages, labels).collect()}
    assert got[35].verdict == "block" and "h:spam" in got[35].mined and got[34].verdict == "allow"
    assert tuple(got[102])[1:5] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[None].rule == "com/fr/"
    assert (got[100].host, got[101].path, got[103].rule, got[104].rule) == ("", "", None, None)
    assert U.judge(spark, pages, labels.limit(0)).where("rule is null and verdict <> 'allow'").count() == 0
    assert U.judge(spark, pages.limit(0), labels).count() == 0
    # every rule agrees with a count over the labelled rows
    tx = [(sorted({"a", f"b{i % 3}"}), "block" if i % 3 == 0 else "allow") for i in range(60)]
    for r in U.mine(spark.createDataFrame(tx, "items array<string>, verdict string"), 0.05, 0.6)[0].collect():
        fit = [v for items, v in tx if set(r.antecedent) <= set(items)]
        assert math.isclose(r.confidence, fit.count(r.verdict) / len(fit)) and r.lift > 1


def test_url_rules_of_tokens_that_always_meet(spark):
    from simgrove.llm import url_rules as U

    tx = [([f"t{k:02}" for k in range(40)] + [f"n{i}" for i in range(i % 9)], "block" if i % 2 else "allow") for i in range(90)] + [(["x"], "allow")] * 30
    rules, stands = U.mine(spark.createDataFrame(tx, "items array<string>, verdict string"), 0.05, 0.5)
    assert rules.count() < 600 and {r.token: r.stands for r in stands.collect()}["t39"] == "t00"
    deep = [([f"p{k:02}" for k in range(i)], "block") for i in range(30)] + [(["x"], "allow")] * 30
    assert 0 < U.mine(spark.createDataFrame(deep, "items array<string>, verdict string"), 0.01, 0.5)[0].count() < 1 << 13


def test_url_rules_of_long_urls(spark):
    from simgrove.llm import url_rules as U

    # y and z together tell all and alone next to nothing; each of 14 other keys tells a little; with brute force
    rng = np.random.default_rng(5)
    rows, bad = [], []
    for i in range(120):
        y, z = i % 2, i // 2 % 2
        bad.append(y ^ z == 0)
        keys = [f"k{k:02}" for k in range(14) if rng.random() < (0.95 if bad[-1] else 0.8)]
        rows.append((i, "http://a.b/?" + "&".join([*keys, f"y{y}", f"z{z}"])))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    known = [(i, 0 if b else 1, 0) for i, b in enumerate(bad) if i < 60]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    want = brute.url_verdicts(rows, known, U.PREFIX_RULES, U.MIN_SUPPORT, U.MIN_CONFIDENCE, U.DEFAULT)
    got = U.judge(spark, pages, labels).collect()
    assert len(got) == 120 and all(r.verdict in want[r.page_id][3] for r in got)
    assert all((r.verdict == "block") == bad[r.page_id] and r.confidence == 1 for r in got)


def test_divergence(spark):
    from simgrove.llm import divergence as D

    rows = [*texts(40, 2), *[(100 + i, t) for i, (_, t) in enumerate(ODD)], (200, "!!! $$$ ### " * 30), (201, "A\nb\nA\n\nb")]
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en")).withColumn("kept", F.lit("clash"))
    for k, name in enumerate(("_n", "_t", "_w", "_lang", "_c0", "row", "_new", "_hr0")):
        df = df.withColumn(name, F.lit(k))
    got = D.judge(df).collect()
    assert all((r._n, r._t, r._w, r._lang, r._c0, r.row, r._new, r._hr0) == tuple(range(8)) for r in got)
    stay = D.kept(df)
    assert stay.columns == df.columns and stay.count() == sum(r.kept for r in got) and stay.where("kept <> 'clash'").count() == 0
    want = {d: brute.base_figures(t) for d, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (r.n_words >= 50) == (r.char_distance is not None)
    assert len(got) == len(rows) and D.judge(df.limit(0)).count() == 0


def test_divergence_of_other_languages(spark):
    from simgrove.llm import divergence as D

    rng = np.random.default_rng(4)
    fill = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), 6)) for _ in range(400)]

    def text(lang, n, common=0.14):
        return " ".join(str(rng.choice(D.COMMON_WORDS[lang] if rng.random() < common else fill)) for _ in range(n))

    clean = [(k, text(k, int(n))) for k in D.COMMON_WORDS for n in rng.integers(80, 400, 40)]
    wrong = [("en", text("de", 200)), ("es", text("fr", 250)), ("fr", text("es", 250)), ("de", text("en", 200))]
    bare = [(k, text(k, 100, 0.0)) for k in D.COMMON_WORDS]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*clean, *wrong, *bare])], "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in D.judge(df).collect()}
    assert all(got[i].kept for i in range(len(clean)))
    assert not any(got[i].kept or got[i].base_failed or got[i].char_distance is None for i in range(len(clean), len(got)))


def test_packing(spark):
    from simgrove.llm import packing as P

    rng = np.random.default_rng(1)
    for n in (0, 1, 400):
        sizes = rng.integers(1, 1025, n)
        place, offset, windows = P.best_fit_decreasing(sizes)
        open_, count = {}, 0  # the same by search
        for k in np.argsort(-sizes, kind="stable"):
            room = [r for r in open_.values() if r >= sizes[k]]
            if not room:
                open_[count], best, count = 1024, count, count + 1
                room = [1024]
            open_room = min(room)
            best = next(w for w, r in open_.items() if r == open_room)
            open_[best] -= sizes[k]
        assert windows == count and all(sorted(offset[place == w].tolist())[0] == 0 for w in range(windows))
    got = P.pack(docs(spark, [*texts(30, 3), *ODD]), P.vocabulary("byte_bpe_50k.json")).toPandas()
    seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (seq["length"].cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all() and seq["length"].sum().max() <= 1024
    assert got["length"].sum() == got[got["start"] == 0]["doc_tokens"].sum()
    assert P.pack(docs(spark, ODD).limit(0), P.vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_again_alone(tmp_path):
    """In a process that has loaded no more than a new worker of an executor: building an Arrow array would load pandas, and that pyarrow.compute."""
    import subprocess

    import pyarrow as pa

    from simgrove.llm import packing as P

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in P.PIECES.split(", "))])
    with pa.ipc.new_stream(str(tmp_path / "pieces"), schema) as out:
        for sizes in ([600, 424], [], [500, 524], [300], [700, 1]):
            out.write_batch(pa.RecordBatch.from_pylist([dict.fromkeys(schema.names, 0) | {"length": n, "ids": b""} for n in sizes], schema))
    code = """
import sys
from types import SimpleNamespace
import pyarrow as pa, pyspark
from simgrove.llm import packing as P
P.HELD_IDS = 2000
pyspark.TaskContext.get = staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0))
batches = list(pa.ipc.open_stream(sys.argv[1]))
assert "pandas" not in sys.modules and "pyarrow.compute" not in sys.modules
for out in P._again(iter(batches)):
    for row in zip(*(out.column(n).to_pylist() for n in ("length", "sequence_id", "offset"))):
        print(*row)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    run = subprocess.run([sys.executable, "-c", code, tmp_path / "pieces"], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    got = [tuple(map(int, x.split())) for x in run.stdout.splitlines()]
    # the first four pieces fill two windows, the others go to a third
    assert [(n, s - P.SECOND, at) for n, s, at in got] == [(600, 0, 0), (424, 0, 600), (500, 1, 524), (524, 1, 0), (300, 2, 700), (700, 2, 0), (1, 2, 1000)]


def test_chat(spark):
    from simgrove.llm import chat as C

    rng = random.Random(2)
    for _ in range(3000):
        x = "".join(rng.choice(["\\", "#", "##", "###", "</turn>", "<", "/turn>", "a"]) for _ in range(rng.randrange(8)))
        assert C.unescape(C.escape(x)) == x and "###" not in C.escape(x) and "</turn>" not in C.escape(x)
    path = C.vocabulary("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, "user", "<|endoftext|>"), (2, 1, "assistant", "é😀 ###</turn>"), (2, 0, "tool\\", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.read_back(C.chat_format(df, path), path).collect()}
    import hashlib

    assert got[1].n_turns == 2 and got[2].loss_sha256 == hashlib.sha256("é😀 ###</turn>".encode()).hexdigest() and got[2].loss_chars == 13
    assert got[2].turns_sha256 == hashlib.sha256("tool\\\n\nassistant\né😀 ###</turn>\n".encode()).hexdigest()
    assert C.chat_format(df.limit(0), path).count() == 0


def test_chat_of_one_long_conversation(spark, monkeypatch):
    from simgrove.llm import chat as C

    path, rng = C.vocabulary("byte_bpe_50k.json"), random.Random(8)
    said = ["###", ": ", "</turn>", "\\", "word ", "\n", "é😀", ":", " "]
    rows = [(1, i, rng.choice(["user", "assistant", "a: b", "a:", "#### "]), "".join(rng.choice(said) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(k, i, "user", "hello") for k in (0, 2, 3) for i in range(3)] + [(5, 0, "assistant", "long text, " * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).withColumn("task", F.lit(3))
    parts = sorted(C.chat_format(df, path).collect(), key=lambda r: (r.conv_id, r.part))
    words = C._decoder(path)
    for k in (0, 1, 2, 3, 5):
        own = [r for r in parts if r.conv_id == k]
        assert [r.part for r in own] == list(range(len(own))) and sum(r.turns for r in own) == sum(x[0] == k for x in rows)
        assert [r.start for r in own] == [sum(len(x.loss_mask) for x in own[:i]) for i in range(len(own))]
        text = b"".join(words[i] for r in own for i in np.frombuffer(r.ids, "<u4").tolist()).decode()
        assert C.read_surface(text) == [(r, t) for c, _, r, t in rows if c == k]
    assert len([r for r in parts if r.conv_id == 1]) > 1  # several tasks share it


def test_warc(spark):
    from simgrove.llm import warc as W
    from simgrove.llm.common import shared_dir

    df = spark.createDataFrame([(1, None, None), (2, "a\r\nb", "x\r\n\r\ny"), (2, "u", "x"), (None, "u", "x"), (None, "u", "only"), (3, "", "x"), (4, "", "")], "page_id long, url string, html string")
    back = W.read_archives(spark, W.write_archives(W.resolve(W.records(df)), shared_dir(spark) + ".warc"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back.collect()), key=repr)
    want = [(1, "revisit", 4, None), (2, "response", None, b"x\r\n\r\ny"), (2, "revisit", 3, None), (None, "revisit", 3, None), (None, "response", None, b"only"), (3, "response", None, b"x"), (4, "response", None, b"")]
    assert got == sorted(want, key=repr)
    # archives with revisits resolve again to the same
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in W.resolve(back).collect()), key=repr) == sorted(((a, b, c) for a, b, c, _ in want), key=repr)
    assert W.read_archives(spark, W.write_archives(W.records(df.limit(0)), shared_dir(spark))).count() == 0


def test_warc_of_many_records(spark):
    from simgrove.llm import warc as W
    from simgrove.llm.common import shared_dir

    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(3_000_000))
    rows = [(i, f"http://h/{i} \t", f"page {i % 1500} " + "x" * (i % 90)) for i in range(4000)] + [(9000, "u", long), (9001, "u", long), (9002, "u", "é\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).withColumn("best", F.lit(1)).coalesce(1)
    manifest = W.write_archives(W.resolve(W.records(df)), shared_dir(spark) + ".warc", "2020-02-02T00:00:00Z")
    assert manifest.agg(F.max("records")).first()[0] == len(rows)
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in W.read_archives(spark, manifest).drop("payload").collect()}
    import base64
    import hashlib

    last = {html: i for i, _, html in rows}
    for i, _, html in rows:
        kind = ("response", None) if last[html] == i else ("revisit", last[html])
        assert got[i] == (*kind, base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())
    with pytest.raises(ValueError):
        import gzip
        import io

        list(W.members(io.BytesIO(gzip.compress(long.encode())[:-20])))


def test_kneser_ney(spark):
    from simgrove.llm import kneser_ney as K

    rows = [*texts(80, 5), (900, None), (901, ""), (902, "É Cat")]
    want = brute.kneser_ney(rows)
    df = docs(spark, rows).withColumn("text", F.coalesce("text", F.lit("")))
    model = K.train(df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2))
    for r in K.score(df, model).collect():
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, model.tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert K.score(df.limit(1), K.train(df.limit(0))).first().score == 0.0


def test_winnowing(spark):
    from simgrove.llm import winnowing as N

    rng = random.Random(7)
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 16)))) for i in range(12)] + [(50, None), (51, ""), (3, "é É A")]
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(40)] + [(None, "A b c a"), *[(d + 100, t) for d, t in ODD if d]]
    df = docs(spark, rows).withColumn("n_hit", F.lit("clash")).withColumn("_th", F.lit(7)).withColumn("_key", F.lit("k")).withColumn("_fk", F.lit(1)).withColumn("row", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_hit, ",".join(r.item_ids)) for r in N.with_hits(df, bench).collect()), key=repr)
    import hashlib

    got = [(d, n, hashlib.sha256(x.encode()).hexdigest()) for d, n, x in got]
    assert sorted(got, key=repr) == sorted(((d, n, h) for d, _, n, _, h, _ in brute.winnow(rows, items)), key=repr)
    left = N.clean(df, bench)
    assert left.columns == df.columns and left.where("_th = 7 and row = 2 and _fk = 1 and n_hit = 'clash'").count() == sum(not hit for *_, hit in brute.winnow(rows, items))
    assert N.with_hits(df, bench.limit(0)).where("n_hit > 0").count() == 0 and N.with_hits(df.limit(0), bench).count() == 0


def test_jaccard(spark):
    from simgrove.llm import jaccard_join as J

    rows = texts(200, 8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute.near_classes(rows) and any(n for _, n in got.values())
    kept = J.one_of_each(docs(spark, [*rows, rows[0]]).withColumn("th", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in got.values()}) and kept.columns == ["doc_id", "text", "th"]
    odd = {r.doc_id: r.class_id for r in J.near_duplicates(docs(spark, [(1, None), (2, None), (3, ""), (4, "a b"), (5, "A  b")])).collect()}
    assert odd == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4} and J.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_jaccard_groups_cut_anew(spark, monkeypatch):
    from simgrove.llm import jaccard_join as J

    for name in ("SURE", "TIE_BLOCK", "LEAST_BLOCK"):
        monkeypatch.setattr(J, name, 4)
    rng = random.Random(3)
    base = [str(rng.randrange(500)) for _ in range(60)]
    near = [" ".join(w if rng.random() > 0.012 else f"e{rng.randrange(9)}" for w in base) for _ in range(60)]
    far = [" ".join(base[:k] + [f"x{j}{i}" for i in range(60 - k)]) for j, k in enumerate((20, 40, 45, 50, 30) * 4)]
    rows = [*enumerate([*near, *far]), *[(1000 + i, t) for i, t in texts(60, 10)]]
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.near_duplicates(docs(spark, rows)).collect()} == brute.near_classes(rows)


def test_jaccard_blocks(monkeypatch):
    from simgrove.llm import jaccard_join as J

    sets = [J.shingles(t) for _, t in texts(150, 9)]
    sig = J.signatures(sets)
    i, j = J.links(sets, sets, sig, sig, True)
    want = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    n = J._common(sets, sets, np.repeat(np.arange(150), 20), np.tile(np.arange(20), 150))
    assert n[25] == len(np.intersect1d(sets[1], sets[5]))


def test_sharding(spark):
    from simgrove.llm import sharding as H

    df = spark.range(4000).withColumnRenamed("id", "doc_id").union(spark.sql("select cast(null as long)")).union(spark.sql("select 7L from range(5)"))
    for n in (1, 3, 16, 17, 18):
        grown = df.withColumn("a", H.shard_of(F.col("doc_id"), H.topology(n))).withColumn("b", H.shard_of(F.col("doc_id"), H.topology(n + 1)))
        if n >= 16:
            assert grown.where(f"a <> b and b <> {n}").count() == 0
        assert grown.agg(F.max("a")).first()[0] <= n - 1
    placed = H.place(df, H.topology(16)).toPandas()
    for _, own in placed.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    base = [H.Leaf("r0", "k0", 0), H.Leaf("r0", "k1", 1, 2.0), H.Leaf("r1", "k0", 2), H.Leaf("r1", "k1", 3)]
    more = [*base[:3], H.Leaf("r1", "k1", 3, 3.0)]
    moved = df.withColumn("a", H.shard_of(F.col("doc_id"), base)).withColumn("b", H.shard_of(F.col("doc_id"), more)).where("a <> b")
    assert moved.count() and moved.where("b not in (2, 3)").count() == 0  # rows move only into the region that grew
    assert H.place(df.limit(0), base).count() == 0
    with pytest.raises(ValueError):
        H.shard_of(F.col("doc_id"), [])


def test_pipeline(spark, tmp_path):
    import pandas as pd

    import corpus_pipeline as P

    rng = random.Random(11)
    long = lambda seed: " ".join(random.Random(seed).choice(WORDS) + str(random.Random(seed * 99 + k).randrange(50)) for k in range(80))
    rows = [(i, long(i)) for i in range(30)] + [(40, long(3) + " more"), (41, long(4)), (42, "short"), (43, long(5) + " " + "q w e r t y u i o p")]
    rng.shuffle(rows)
    pd.DataFrame([(d, t, "en", "s", len(t)) for d, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(1, "q w e r t y u i o p")], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = P.quality_rules(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert 42 not in ids
    good = [(d, t) for d, t in rows if d in ids]
    classes = brute.near_classes(good)
    left = [(d, t) for d, t in good if classes[d][0] == d]
    left = {d for d, *_, hit in brute.winnow(left, [(1, "q w e r t y u i o p")]) if not hit}
    got = P.run(spark, str(tmp_path)).toPandas()
    assert set(got["doc_id"]) == left and got["length"].sum() == got[got["start"] == 0]["doc_tokens"].sum()
    assert zlib.crc32(b"") == 0
