"""The operators for training data against brute force, and on awkward input."""

import gzip
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trestle.llm import bpe, langid, minhash, mixing, quality_model, quality_rules, secret_scan, topk, toxicity, warc
from trestle.llm.automaton import SpanFinder, compile_patterns, scan
from trestle.llm.textfeat import shingles, words

WORDS = "river stone market window garden letter silver morning engine paper bridge winter doctor yellow forest".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ly"]) + rng.choice(["", "", "", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with every awkward case, and columns whose names clash with those the operators use."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(20, 80)), "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, rows[1][1].replace("river", "sea", 1), "en", None, 0)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (None, "lost and found", "en", "s1", 1), (202, "x", "de", "s2", 1), (203, prose(rng, 60_000), "en", "s0", 0)]
    rows += [(300, "same row twice " * 5, "en", "s1", 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "key", "token", "sig", "keep", "tokens", "place", "score", "rank", "tag_"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_sample_comes_from_many_files_and_keeps_filters(spark, tmp_path):
    from trestle.llm.common import sample_rows

    spark.range(0, 2000, 1, 20).withColumn("text", F.col("id").cast("string")).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    got = [r["id"] for r in sample_rows(scan, 80).collect()]
    assert len(got) == 80 and len({i // 100 for i in got}) == 8
    few = sample_rows(scan.where("id >= 1990").select(F.col("id").alias("x")), 80).collect()
    assert sorted(r["x"] for r in few) == list(range(1990, 2000))
    assert sample_rows(scan.where("id < 0"), 5).count() == 0


def test_training_samples_see_the_whole_table(spark, tmp_path):
    from trestle.llm.common import spread_sample

    rng = random.Random(4)
    rows = [(i, None if i < 60 else prose(rng, 12) if i < 360 else "", None if i < 120 else "aa") for i in range(400)]
    rows += [(400 + i, " ".join("".join(rng.choice("opqrsß") for _ in range(5)) for _ in range(12)), "zz") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/clustered")
    docs = spark.read.parquet(f"{tmp_path}/clustered")
    net = langid.labelled_network(docs, rows=40)
    assert net.languages == ["aa", "zz"]
    got = spread_sample(docs.unionAll(docs), "text", F.col("lang"), lambda counts: dict.fromkeys(counts, 30))
    assert {g: len({t for t, h in got if h == g}) for g in ("aa", "zz")} == {"aa": 30, "zz": 20} and len(got) == 50
    assert sorted(got) == sorted(spread_sample(docs.repartition(7), "text", F.col("lang"), lambda counts: dict.fromkeys(counts, 30)))
    assert spread_sample(docs.where("lang IS NULL"), "text", F.col("lang"), dict) == []


def test_quality_sample_has_every_vote_pattern(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, prose(rng, 30)) for i in range(300)] + [(300 + i, prose(rng, 4) + " $# %% =~ ^" * 9) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/q")
    seen = []
    monkeypatch.setattr(quality_model, "fit_scorer", lambda texts, good, fit=quality_model.fit_scorer: (seen.extend(texts), fit(texts, good))[1])
    quality_model.score(spark.read.parquet(f"{tmp_path}/q"), rows=100)
    assert len(seen) <= 100 and 5 <= sum("$#" in t for t in seen) <= 15


# 1
def test_rules_cascade_agrees_with_every_order(spark, corpus):
    bad = spark.createDataFrame([(1, "$$$ ### %%%" * 9), (2, "A | B | C | D"), (3, "HELLO WORLD LOUD"), (4, "go go go go go go"), (5, "A fine sentence about rivers."), (6, " \n"), (7, "wow!!!!!!")], "doc_id long, text string")
    got = {r[0]: r[1] for r in quality_rules.judge(bad).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False, 7: False}
    for order in (quality_rules.RULES, quality_rules.RULES[::-1]):
        rows = bad.select("doc_id", quality_rules.passes("text", order).alias("k")).collect()
        assert {r[0]: r[1] for r in rows} == got
    ordered = quality_rules.order_rules(bad)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality_rules.RULES)


def test_rules_on_awkward_input(corpus, nothing):
    got = quality_rules.judge(corpus).collect()
    assert len(got) == corpus.count()
    keep = {r["doc_id"]: r["keep"] for r in got}
    assert not keep[200] and not keep[201] and keep[0] and keep[203]
    assert quality_rules.judge(nothing).count() == 0


# 2
def test_automaton_equals_regex():
    rng = random.Random(1)
    patterns = ["ab+c", "(?:ab|ba){2,3}", "a[^b]c", "c.{2}a"]
    automaton = compile_patterns(patterns)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40))).encode()
        mask = int(scan(automaton, np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0])
        assert mask == sum(1 << k for k, p in enumerate(patterns) if re.search(p.encode(), text, re.S))
    finder = SpanFinder("ab+")
    assert finder.spans(b"xabbbaab") == [(1, 5), (6, 8)]


def test_secrets_found_across_segments(spark, corpus, nothing):
    key = "AKIA" + "A1" * 8
    rows = [(1, "x " * 2045 + key + " end"), (2, f"token={key}"), (3, None), (4, ""), (5, f"{key} {key}"), (6, "no secret"), (5, f"{key} {key}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rule", F.lit(0)).withColumn("id", F.lit(1))
    got = sorted((r[0], r[1], r[2]) for r in secret_scan.find_secrets(df).collect())
    assert [g for g in got if g[1] == "aws_access_key"] == [(1, "aws_access_key", 1), (2, "aws_access_key", 1), (5, "aws_access_key", 2), (5, "aws_access_key", 2)]
    assert [g for g in got if g[1] != "aws_access_key"] == [(2, "assigned_secret", 1)]
    clean = [r[0] for r in df.select(secret_scan.redacted(spark, F.col("text"))).collect()]
    assert clean[2] is None and clean[3] == "" and clean[5] == "no secret" and not any(key in (c or "") for c in clean)
    assert secret_scan.find_secrets(corpus).count() == 0 and secret_scan.find_secrets(nothing).count() == 0


def test_secrets_behind_punctuation_and_in_any_url(spark):
    hub, key = "ghp_" + "a1B2" * 9, "AKIA" + "Q7" * 8
    rows = [f"https://{hub}@github.com", f"/{key}", f"x.{key} my_{key}", "mongodb+srv://user:pw@host", "postgresql+psycopg2://u:pw@host", "redis://:pw@host", f"Z{key}", "http://host:80/a@b", "x-AIza" + "b-" * 17 + "c", "AIza is no key"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in secret_scan.find_secrets(df).collect())
    assert got == [(0, "github_token", 1), (1, "aws_access_key", 1), (2, "aws_access_key", 2), (3, "url_password", 1), (4, "url_password", 1), (5, "url_password", 1), (8, "google_api_key", 1)]
    clean = [r[0] for r in df.select(secret_scan.redacted(spark, F.col("text"))).collect()]
    aws, url = "[secret:aws_access_key]", "[secret:url_password]"
    assert clean == ["https://[secret:github_token]@github.com", f"/{aws}", f"x.{aws} my_{aws}", f"{url}host", f"{url}host", f"{url}host", *rows[6:8], "x-[secret:google_api_key]", rows[9]]


def test_private_keys_go_whole(spark):
    rng = random.Random(9)
    line = lambda n=64: "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(n))
    block = lambda kind, *lines, sep="\n": sep.join([f"-----BEGIN {kind}PRIVATE KEY-----", *lines, f"-----END {kind}PRIVATE KEY-----"])
    one, two = block("RSA ", line(), line(), line(21) + "="), block("", line(), line(5) + "==", sep="\\n")
    sealed = block("EC ", "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", "", line(), line(9))
    cut = one[: one.rindex("\n-----END")]
    rows = [(1, f"a {one} b - c {two} d"), (2, f"é {sealed} é"), (3, f"x\n{cut}"), (4, "-----BEGIN PRIVATE KEY----- is how a header begins"), (5, one), (6, block("RSA ", line(), line(), line(21) + "="))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r[0]: r[1] for r in df.select("doc_id", secret_scan.redacted(spark, F.col("text"))).collect()}
    mark = "[secret:private_key]"
    assert clean == {1: f"a {mark} b - c {mark} d", 2: f"é {mark} é", 3: f"x\n{mark}", 4: f"{mark} is how a header begins", 5: mark, 6: mark}
    found = {r["doc_id"]: (r["n_matches"], r["first_sha256"]) for r in secret_scan.find_secrets(df).collect()}
    assert found[1] == (2, hashlib.sha256(one.encode()).hexdigest()) == (2, found[5][1]) and found[6][1] != found[5][1]


# 3
def test_archive_round_trip_and_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://b\r\nX: y", "WARC/1.1\r\n\r\n"), (5, "http://c", ""), (6, "http://d", "z" * 300_000), (1, "http://a/1", "<p>é</p>")], "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.deduplicated(pages, path).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "revisit", 3), (6, "response", None)]
    back = warc.read_archive(spark, path).collect()
    assert len(back) == 7
    for r in back:
        assert (r["payload"] is None) == (r["type"] == "revisit") and "\n" not in r["uri"]
        if r["payload"] is not None:
            assert hashlib.sha256(r["payload"].encode()).hexdigest() == r["digest"]
    ids = {r["record_id"] for r in back if r["type"] == "response"}
    assert all(r["refers_to"] in ids for r in back if r["type"] == "revisit")
    files = list((tmp_path / "w").glob("*.warc.gz"))
    raw = [gzip.open(f).read() for f in files]
    assert sum(r.count(b"WARC-Type: ") - r.count(b"WARC-Type: warcinfo") for r in raw) == 7 and all(r.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for r in raw)
    import zlib

    for f, whole in zip(files, raw):
        data, members = f.read_bytes(), []
        while data:  # a member of gzip for each record
            d = zlib.decompressobj(31)
            members.append(d.decompress(data))
            data = d.unused_data
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members) and len(members) == whole.count(b"WARC-Type: ")
    assert not list((tmp_path / "w").glob("_part*"))
    assert re.search(rb"WARC-Date: 20[2-9]\d-\d\d-\d\dT[\d:]{8}Z", raw[0])


def test_revisits_without_payload_are_joined(spark):
    records = spark.createDataFrame([(1, "response", "u1", "d1", "x"), (2, "revisit", "u2", "d1", None), (3, "revisit", "u3", "d9", None)], "id long, kind string, uri string, digest string, payload string")
    got = {r["id"]: (r["kind"], r["refers_to"]) for r in warc.resolve(records).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1), 3: ("revisit", None)}


def test_revisits_equal_sql(spark):
    import duckdb

    rng = random.Random(15)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["response", "response", "revisit"]), rng.choice("uvw"), f"d{rng.randrange(25)}", None) for _ in range(200)]
    got = [tuple(r) for r in warc.resolve(spark.createDataFrame(rows, "id long, kind string, uri string, digest string, payload string")).select("id", "uri", "digest", "kind", "refers_to", "refers_uri").collect()]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE r (id BIGINT, kind VARCHAR, uri VARCHAR, digest VARCHAR, payload VARCHAR)")
        db.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?)", rows)
        want = db.execute("""WITH o AS (SELECT digest, min((id, uri)) AS f FROM r WHERE kind = 'response' AND id IS NOT NULL GROUP BY digest),
x AS (SELECT r.*, f, kind = 'revisit' OR coalesce(id <> f[1], false) AS again FROM r LEFT JOIN o ON r.digest = o.digest)
SELECT id, uri, digest, CASE WHEN again THEN 'revisit' ELSE 'response' END, CASE WHEN again THEN f[1] END, CASE WHEN again THEN f[2] END FROM x""").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[3] == "revisit" for r in got) > 50


def test_null_ids_leave_the_rest_of_their_digest_deduplicated(spark, tmp_path):
    import duckdb

    rows = [(None, "http://n", "same"), (7, "http://b", "same"), (5, "http://a", "same"), (None, "http://m", "alone"), (9, "http://c", None), (None, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    path = f"file://{tmp_path}/n"
    got = [tuple(r) for r in warc.deduplicated(spark.read.parquet(f"{tmp_path}/pages"), path).collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
        assert sorted(got, key=str) == sorted(db.execute(warc.oracle()).fetchall(), key=str)
    assert [r[3] for r in got if r[0] == 7] == [5]
    back = warc.read_archive(spark, path).collect()
    assert sorted((r["uri"], r["type"]) for r in back) == [("http://a", "response"), ("http://b", "revisit"), ("http://c", "response"), ("http://m", "response"), ("http://n", "response"), ("urn:unknown", "response")]
    records = spark.createDataFrame([(None, "revisit", "u0", "d1", None), (1, "response", "u1", "d1", "x"), (None, "response", "u2", "d1", "x")], "id long, kind string, uri string, digest string, payload string")
    warc.write_archive(records, f"file://{tmp_path}/r")
    kept = {r["uri"]: r for r in warc.read_archive(spark, f"file://{tmp_path}/r").collect()}
    assert {u: r["type"] for u, r in kept.items()} == {"u0": "revisit", "u1": "response", "u2": "response"} and kept["u0"]["refers_to"] == kept["u1"]["record_id"]


def test_empty_archive(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.deduplicated(none, f"file://{tmp_path}/e").count() == 0


# 4
def test_exponent_meets_its_targets():
    sizes = [1000, 100, 10]
    a = mixing.solve_exponent(sizes, max_repeats=4)
    assert (1000 / 10) ** (1 - a) <= 4 < (1000 / 10) ** (1 - a + 1e-5)
    b = mixing.solve_exponent(sizes, target_entropy=0.9)
    w = [s**b for s in sizes]
    entropy = lambda b: -sum(x / sum(w) * math.log(x / sum(w)) for w in [[s**b for s in sizes]] for x in w)
    assert entropy(b) >= 0.9 * math.log(3) > entropy(b + 1e-5) and w
    assert mixing.solve_exponent([5]) == 1.0 == mixing.solve_exponent([]) == mixing.solve_exponent([3, 0], 2)


def test_mix_equals_brute_force(spark, corpus, nothing):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 40)), "s0" if i < 150 else f"s{i % 3}" if i % 7 else None) for i in range(260)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["_copy"]) for r in mixing.mix(df, max_repeats=3.0).collect())
    even = {r["source"]: r["n"] for r in mixing.mix(df, max_repeats=None, target_entropy=0.999).groupBy("source").agg(F.sum(mixing.token_estimate("text")).alias("n")).collect()}
    shares = [n / sum(even.values()) for n in even.values()]
    assert -sum(p * math.log(p) for p in shares) >= 0.99 * math.log(len(shares)) and len(shares) == 4
    tokens = {r[0]: (len(r[1].encode()) + 3) // 4 for r in rows}
    sums: dict = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + tokens[i]
    a = mixing.solve_exponent(list(sums.values()), 3.0)
    want = []
    for s, t in sums.items():
        spend = math.floor((t / max(sums.values())) ** (a - 1) * t)
        left = spend - spend // t * t
        for i, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5((mixing.SEED + str(r[0])).encode()).hexdigest()):
            left -= tokens[i]
            want += [(i, k) for k in range(spend // t + (left >= 0))]
    assert got == sorted(want) and len(got) > len(rows)
    mixed = mixing.mix(corpus)
    assert mixed.where("_copy = 0").count() == corpus.count() and mixing.mix(nothing).count() == 0
    clash = df
    for name in ("_copy", "_key", "_full", "mix_key", "mix_full", "mix_until", "mix_copy", "tokens", "block"):
        clash = clash.withColumn(name, F.lit("clash"))
    again = mixing.mix(clash, max_repeats=3.0, copy_col=None)
    assert again.columns == clash.columns and again.count() == len(got) and again.where("_copy <> 'clash' OR mix_copy <> 'clash'").isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(clash)
    assert set(mixing.mix(df, budget=500).columns) == {"doc_id", "text", "source", "_copy"} and mixing.mix(df, budget=500).count() < 260


# 5
def test_language_network_learns_and_labels_every_byte(spark, nothing):
    rng = random.Random(2)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [make("abcdeé", 60) if i % 2 else make("opqrsß", 60) for i in range(80)]
    net = langid.train([t.encode() for t in texts], ["xx" if i % 2 else "yy" for i in range(80)], steps=60)
    held = [make("abcdeé", 200), make("opqrsß", 3), make("opqrsß", 900), "", None]
    p = langid.pooled(net, pa.array(held, pa.string()))
    assert p[:3].argmax(1).tolist() == [0, 1, 1] and not p[3:].any()
    raw = (make("abcdeé", 60) + " " + make("opqrsß", 60)).encode()
    runs = langid.spans(net, raw)
    assert runs[0][0] == 0 and runs[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(runs, runs[1:])) and runs[0][2] == "xx" and runs[-1][2] == "yy"
    df = spark.createDataFrame([(1, held[0]), (2, ""), (3, None), (1, held[0])], "doc_id long, text string").withColumn("predicted", F.lit(0))
    got = [(r[0], r[1], r[3]) for r in langid.identify(df, net=net).collect()]
    assert got == [(1, "xx", len(held[0].encode())), (2, None, 0), (3, None, 0), (1, "xx", len(held[0].encode()))]
    assert langid.identify(nothing).count() == 0


def test_language_segments_see_the_same_as_one_pass(monkeypatch):
    rng = random.Random(12)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    net = langid.train([make("abc def é ", 300).encode() for _ in range(20)] + [make("xyz uvw ", 300).encode() for _ in range(20)], ["a"] * 20 + ["b"] * 20, steps=60)

    def one_pass(raw):
        ahead, _ = langid._states(raw[None, :], net.inputs[0], net.recurrence[0])
        behind, _ = langid._states(raw[None, ::-1], net.inputs[1], net.recurrence[1])
        logits = np.stack(ahead[1:])[:, 0] @ net.output[0] + np.stack(behind[1:])[::-1, 0] @ net.output[1] + net.bias
        return np.exp(logits) / np.exp(logits).sum(1, keepdims=True)

    texts = [make(rng.choice(["abc def xyz ", "abc", "uvw xyz", "é a"]), n).encode() for n in (300, 0, 1, 511, 512, 513, 5_000, 40_000)] + [b" " * 3000]
    buf, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    for lanes in (4096, 7):
        monkeypatch.setattr(langid, "LANES", lanes)
        got, of = np.zeros((len(buf), 2)), np.full(len(buf), -1)
        for doc, place, p in langid.positions(net, buf, starts, ends):
            got[place], of[place] = p, doc
        assert (of == np.repeat(np.arange(len(texts)), ends - starts)).all()
        for s, e in zip(starts, ends):
            assert e == s or np.abs(got[s:e] - one_pass(buf[s:e])).max() < 1e-5


def random_network(seed, languages):
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.5).astype(np.float32)
    return langid.Network(languages, [draw(256, 24) for _ in range(2)], [draw(8, 24) for _ in range(2)], [draw(8, len(languages)) for _ in range(2)], draw(len(languages)))


@pytest.mark.parametrize("lanes", [4096, 5])
def test_language_means_equal_those_of_one_pass(monkeypatch, lanes):
    net, rng = random_network(1, ["a", "b", "c"]), random.Random(8)
    texts = ["".join(rng.choice("abc dé") for _ in range(n)) for n in (700, 0, 1, 7, 8, 9, 511, 2000, 30, 9000)] + [None, "z"]
    monkeypatch.setattr(langid, "LANES", lanes)
    column = pa.array(["dropped", *texts], pa.string())[1:]
    for text, got in zip(texts, langid.pooled(net, column)):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        ahead, _ = langid._states(raw[None, :], net.inputs[0], net.recurrence[0])
        behind, _ = langid._states(raw[None, ::-1], net.inputs[1], net.recurrence[1])
        logits = sum((np.stack(h[1:])[::w, 0] @ o for h, o, w in ((ahead, net.output[0], 1), (behind, net.output[1], -1))), net.bias) if len(raw) else np.zeros((0, 3))
        p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        assert np.abs(got - (p.mean(0) if len(raw) else 0)).max() < 1e-5


def test_labelling_costs_less_than_the_plain_recurrence():
    net, rng = random_network(2, ["a", "b", "c", "d"]), np.random.default_rng(3)
    raw = rng.integers(97, 123, (4096, 256)).astype(np.uint8)
    column = pa.array([bytes(r).decode() for r in raw], pa.string())

    def seconds(f):
        took = []
        for _ in range(4):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    def plain():
        for side in range(2):
            h = np.zeros((len(raw), 8), np.float32)
            for t in range(raw.shape[1]):
                h, _ = langid._cell(net.inputs[side][raw[:, t]], h, net.recurrence[side])

    assert seconds(lambda: langid.pooled(net, column)) < seconds(plain)


def test_language_of_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0 AND lang IS NOT NULL")
    seen = F.xxhash64("text") % 2 == 0
    net = langid.labelled_network(docs.where(seen), rows=400)
    held = docs.where(~seen).join(docs.where(seen).select("text"), "text", "left_anti")
    rows = langid.identify(held, net=net).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 300 and np.mean([r["predicted"] == r["lang"] for r in rows]) > 0.97


# 6
def test_words_and_shingles_equal_plain_python():
    texts = ["Ab c-ab c", None, "", "é é x", "...", "one", "a b " * 9]
    seen: dict = {}
    for i, _, row, h in words(pa.array(texts, pa.string())):
        plain = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[a-z0-9\u0080-￿]+", (t or "").lower())]
        assert [r + i for r in row.tolist()] == [k for k, _ in plain]
        for (_, w), x in zip(plain, h.tolist()):
            assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)
        r2, _ = shingles(row, h, 3)
        assert np.bincount(r2, minlength=7).tolist() == [2, 0, 0, 1, 0, 1, 16]


def brute_classes(sigs, least):
    """Class and number of links of each document that has a copy, from all pairs; ``sigs`` are (id, signature)."""
    root = {i: i for i, _ in sigs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links: dict = {}
    for (a, s), (b, t) in itertools.combinations(sigs, 2):
        if (s == t).sum() >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            if s.tobytes() != t.tobytes():
                links.setdefault((a, s.tobytes()), set()).add(t.tobytes())
                links.setdefault((b, t.tobytes()), set()).add(s.tobytes())
    sizes: dict = {}
    for i in root:
        sizes[find(i)] = sizes.get(find(i), 0) + 1
    return {i: (find(i), sum(len(v) for (j, _), v in links.items() if j == i)) for i in root if sizes[find(i)] > 1}


@pytest.mark.parametrize("tile", [2048, 3])
def test_inverted_join_equals_all_pairs(spark, monkeypatch, tile):
    rng = random.Random(4)
    rows = []
    for g in range(30):
        base = prose(rng, rng.randint(15, 60)).split()
        for k in range(rng.choice([1, 1, 2, 3, 9])):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + i, rows[5 * i][1]) for i in range(6)] + [(7, rows[40][1]), (3000, prose(rng, 30)), (3000, rows[0][1]), (3001, "")]
    monkeypatch.setattr(minhash, "TILE", tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sig, has = minhash.signatures_of(pa.array([t for _, t in rows]))
    want = brute_classes([(i, s) for (i, _), s, h in zip(rows, sig, has) if h], math.ceil(minhash.THRESHOLD * minhash.K))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in minhash.classes(df).collect()}
    assert got == want and len(got) > 20 and max(n for _, n in got.values()) > 3


def test_signatures_estimate_jaccard():
    rng = random.Random(6)
    for cut in (10, 40, 80):
        a = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        b = a[: 300 - cut] + [f"v{i}" for i in range(cut)]
        s = [set(zip(x, x[1:], x[2:])) for x in (a, b)]
        sig, _ = minhash.signatures_of(pa.array([" ".join(a), " ".join(b)]))
        assert abs((sig[0] == sig[1]).mean() - len(s[0] & s[1]) / len(s[0] | s[1])) < 0.2


def test_long_lists_count_every_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1000, 96).astype(np.uint32)
    sig = np.tile(base, (300, 1))
    for i in range(300):
        sig[i, rng.integers(0, 96, 40)] = rng.integers(1000, 1100, 40)
    want = np.array([((sig == s).sum(axis=1) >= 45).sum() - 1 for s in sig])
    rows = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sig)], "node long, sig binary")
    for tile in (2048, 100):
        monkeypatch.setattr(minhash, "TILE", tile)
        got = minhash.partners(rows).groupBy("node").agg(F.sum("links").alias("n"), F.count("*").alias("lists")).collect()
        assert {r["node"]: r["n"] for r in got} == {i: n for i, n in enumerate(want) if n}
    assert 0 < want.min() and want.max() < 299 or len(set(want.tolist())) > 3


def test_dedup_on_awkward_input(corpus, nothing):
    kept = minhash.without_copies(corpus)
    found = {r["doc_id"]: r["class_id"] for r in minhash.classes(corpus.withColumn("gone", F.lit(1)).withColumn("class_id", F.lit(1))).collect()}
    gone = {i for i, c in found.items() if i != c}
    assert found[100] == found[0] == 0 and not {200, 201, 300, None} & set(found)
    clash = minhash.without_copies(corpus.withColumn("gone", F.lit(1)).withColumn("class_id", F.lit(1)))
    assert kept.columns == corpus.columns and kept.count() == corpus.count() - len(gone) == clash.count()
    assert minhash.classes(nothing).count() == 0 and minhash.without_copies(nothing).count() == 0


# 7
@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        t = prose(rng, rng.randint(20, 60)).split()
        if i % 5 == 0:
            for w in rng.sample(["idiot", "moron", "trash", "scum", "worthless", "clown"], 3):
                t.insert(rng.randrange(len(t)), w)
        rows.append((i, " ".join(t), int(i % 5 == 0)))
    return rows


def chain_labels(toxic_docs):
    """Quality (known for most) and toxicity."""
    return np.array([[np.nan if i % 7 == 3 else float(not y or i % 2), y] for i, _, y in toxic_docs])


def test_chain_is_accurate_on_held_out(toxic_docs):
    texts, y = [r[1] for r in toxic_docs], chain_labels(toxic_docs)
    chain = toxicity.fit_chain(texts[:160], y[:160])
    assert [len(link.chain) for link in chain] == [0, 1]
    rows, buckets = toxicity.features(pa.array(texts[160:]))
    before = np.zeros((80, 0))
    for link in chain:
        before = np.column_stack([before, toxicity._apply(link, rows, buckets, before)])
    assert ((before[:, -1] >= 0.5) == (y[160:, 1] > 0)).all()


def test_chain_equals_plain_models_and_stays_out_of_fold(toxic_docs, monkeypatch):
    texts, y = toxicity._once([r[1] for r in toxic_docs], chain_labels(toxic_docs))
    rows, buckets = toxicity.features(pa.array(texts))
    n, shown = len(texts), []
    monkeypatch.setattr(toxicity, "_fit_rows", lambda r, b, y, before, train, fit=toxicity._fit_rows: (shown.append(train.copy()), fit(r, b, y, before, train))[1])
    chain = toxicity.fit_chain(texts, y)
    folds = np.arange(n) % toxicity.FOLDS
    assert len(shown) == 2 + toxicity.FOLDS and (shown[0] == ~np.isnan(y[:, 0])).all() and shown[-1].all()
    assert all(not shown[1 + f][folds == f].any() and not shown[1 + f][np.isnan(y[:, 0])].any() for f in range(toxicity.FOLDS))

    def plain(chosen, y, before, train):
        """Logistic regression over a dense matrix of words, built text by text."""
        x = np.zeros((n, len(chosen)), np.float32)
        for r, w in zip(rows.tolist(), buckets.tolist()):
            if w in chosen:
                x[r, chosen.index(w)] = 1
        x = np.hstack([x, before.astype(np.float32)])
        w, b = toxicity.fit_logistic(x[train], y[train], penalty=0.1)
        return toxicity.sigmoid(x @ w + b)

    def telling(y, train):
        with_pos, total = {}, {}
        for r, w in zip(rows.tolist(), buckets.tolist()):
            if train[r]:
                total[w], with_pos[w] = total.get(w, 0) + 1, with_pos.get(w, 0) + y[r]
        pos, m, out = y[train].sum(), train.sum(), []
        for w, k in sorted(total.items()):
            spread = math.sqrt(k / m * (1 - k / m) * (1 / max(pos, 1) + 1 / max(m - pos, 1)))
            if k >= toxicity.MIN_TEXTS and abs(with_pos[w] / max(pos, 1) - (k - with_pos[w]) / max(m - pos, 1)) >= toxicity.MIN_Z * max(spread, 1e-9):
                out.append(w)
        return out

    known, every, none = ~np.isnan(y[:, 0]), np.ones(n, bool), np.zeros((n, 0))
    held = np.zeros(n)
    for f in range(toxicity.FOLDS):
        train = known & (folds != f)
        held[folds == f] = plain(telling(y[:, 0], train), y[:, 0], none, train)[folds == f]
    assert np.allclose(held, toxicity.out_of_fold(rows, buckets, y[:, 0], none), atol=1e-4)
    want = plain(telling(y[:, 1], every), y[:, 1], held[:, None], every)
    assert np.allclose(want, toxicity._apply(chain[1], rows, buckets, held[:, None]), atol=1e-3)


def test_toxicity_on_awkward_input(spark, corpus, nothing, toxic_docs):
    known = spark.createDataFrame([(r[0] + 1000, r[1]) for r in toxic_docs], "doc_id long, text string")
    lab = labels(spark, [(r[0] + 1000, 1, r[2]) for r in toxic_docs] + [(None, 1, 1), (5, None, None), (6, None, 0), (1001, 0, 0)])
    both = known.unionByName(corpus.select("doc_id", "text")).withColumn("p_toxic", F.lit("clash"))
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.score(both, lab).collect()}
    assert not got[200] and not got[201] and not got[203] and got[1000] and not got[1001]
    kept = toxicity.without_toxic(both, both, lab)
    assert kept.columns == both.columns and kept.count() == both.count() - sum(got.values())
    assert toxicity.score(nothing, lab).count() == 0
    assert toxicity.score(corpus, labels(spark, [])).where("is_toxic").count() == 0


# 8
def test_estimated_votes_recover_planted_rates():
    rng = random.Random(5)
    counts: dict = {}
    for _ in range(4000):
        good = rng.random() < 0.8
        v = "".join("-" if rng.random() < (0.002 if good else hit) else "0" for hit in (0.5, 0.4, 0.6)) + ("+" if rng.random() < (0.9 if good else 0.2) else "0")
        counts[v] = counts.get(v, 0) + 1
    rates, posterior = quality_model.estimate(counts)
    assert abs(rates[0, 0, 0] - 0.5) < 0.1 and abs(rates[2, 0, 0] - 0.6) < 0.1 and abs(rates[3, 1, 1] - 0.9) < 0.05
    assert posterior["000+"] > 0.9 and posterior["--00"] < 0.01
    assert quality_model.estimate({})[1] == {}


def test_votes_equal_plain_python():
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab A\u00c4\u00e9|!#$%\u65e5\n") for _ in range(n)) for n in (1, 5, 50, 200, 1000)] + [None, "", "go go go stop stop", "x" * 700_000 + " ! " * 9000, "ÄÖÜ ÉÉ"]
    got = quality_model.votes(pa.array(texts, pa.string()))
    for t, v in zip(texts, got):
        if not t:
            assert v is None
            continue
        own = re.findall(r"[a-z0-9\u0080-￿]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        share = {n: sum(c in chars for c in t) / len(t) for n, chars in quality_model.CHARACTERS.items()}
        share["again"] = sum(a == b for a, b in zip(own, own[1:])) / max(len(own), 1)
        share["thrice"] = sum(a == b == c for a, b, c in zip(own, own[1:], own[2:])) / max(len(own), 1)
        sums = [sum(share[n] for n in names) for _, names, _, _ in quality_model.LABELLERS]
        assert v == "".join("-" if m > bad else "+" if m < good else "0" for m, (_, _, bad, good) in zip(sums, quality_model.LABELLERS))


def test_estimate_equals_plain_expectation_maximisation():
    rng = random.Random(14)
    counts = {"".join(rng.choice("0-+") for _ in range(3)): rng.randint(1, 90) for _ in range(12)}
    rates, posterior = quality_model.estimate(counts, rounds=7)
    good = {p: 0.03 if "-" in p else 0.97 for p in counts}
    for _ in range(7):
        mass = [sum(n * (1 - good[p]) for p, n in counts.items()), sum(n * good[p] for p, n in counts.items())]
        rate = {}
        for j, (v, c) in itertools.product(range(3), itertools.product("-+0", (0, 1))):
            cast = sum(n * (good[p] if c else 1 - good[p]) for p, n in counts.items() if p[j] == v)
            rate[j, v, c] = (cast + 1) / (mass[c] + 3)
            if v == "-" and c == 1:
                rate[j, v, c] = min(rate[j, v, c], quality_model.FALSE_ALARMS)
        for p in counts:
            odds = (mass[1] + 1) / (mass[0] + 1) * math.prod(rate[j, v, 1] / rate[j, v, 0] for j, v in enumerate(p))
            good[p] = odds / (1 + odds)
    assert all(abs(posterior[p] - good[p]) < 1e-9 for p in counts)
    assert all(abs(rates[j, "-+0".index(v), c] - r) < 1e-9 for (j, v, c), r in rate.items())


def test_scores_equal_plain_sums():
    texts = ["abc abc abd", "", None, "ab", "é|é|é|é", "the end of the end"] * 3
    w, mean, b = quality_model.fit_scorer([t for t in texts if t] * 4, np.tile([1.0, 0.0, 1.0, 0.0], 12))
    got = quality_model.scores(pa.array(texts, pa.string()), w, mean, b)
    for t, s in zip(texts, got):
        raw = (t or "").encode()
        grams = [int(quality_model._buckets(np.frombuffer(raw[i : i + 3], np.uint8))[0]) for i in range(len(raw) - 2)]
        own = (t or "").split()
        again = sum(x == y for x, y in zip(own, own[1:])) / max(len(own), 1) if "|" not in (t or "") else 3 / 4
        x = sum(w[g] for g in grams) / max(len(grams), 1) + w[-1] * again - mean
        assert abs(s - (1 / (1 + math.exp(-(x * len(raw) / (len(raw) + 100) + b))) if raw else 0)) < 1e-5


def test_quality_scores_held_out_and_awkward(spark, corpus, nothing):
    rng = random.Random(7)
    rows = []
    for i in range(200):
        t = prose(rng, rng.randint(30, 80))
        rows.append((i, " ".join(w + rng.choice(["$$$", "###", "&&&"]) for w in t.split()) if i % 4 == 0 else t))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(corpus.select("doc_id", "text").where("doc_id >= 200")).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality_model.score(df).collect()}
    assert np.mean([got[i]["keep"] == (i % 4 != 0) for i in range(200)]) > 0.97
    assert got[200]["score"] == 0 and not got[201]["keep"] and got[203]["keep"]
    assert quality_model.score(nothing).count() == 0


# 9
@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(bpe.vocabulary_path())


def test_chunked_encoding_is_exact(ranks):
    rng = random.Random(1)
    shared = prose(rng, 900)
    texts = [prose(rng, 600) + shared + prose(rng, 300) for _ in range(12)]
    texts += ["", "a" * 6000, " " * 3000, "a b " * 2000, "\n\n  x" * 900, "don't 'll we've " * 500, "é   x y" * 700, "ü" * 4000, "日本語 テキスト" * 400, "🙂" * 900, "<|endoftext|>" * 90]
    texts += ["".join(rng.choice(" \n'a1.é🙂s") for _ in range(3000)) for _ in range(20)]
    machine = bpe.Encoder(ranks)
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        assert machine.encode(b).tolist() == machine.plain(t)
    assert machine.reused > 10
    kana = "これは日本語の文章です。句読点、そして改行なし。東京！大阪？"
    no_spaces = ["".join(rng.choice(kana) for _ in range(6000)), kana * 300, "龦。䷀。。、、あ。" * 500]
    seen = machine.encoded
    for t in no_spaces:
        assert machine.encode(np.frombuffer(t.encode(), np.uint8)).tolist() == machine.plain(t)
    assert len(bpe.anchors(np.frombuffer(no_spaces[0].encode(), np.uint8))) > 300 and machine.encoded > seen
    with pytest.raises(ValueError):
        bpe.Encoder(ranks, pattern=r"\S+|\s+")
    small = bpe.Encoder(ranks, kept_bytes=5000)
    assert all(small.encode(np.frombuffer(t.encode(), np.uint8)).tolist() == small.plain(t) for t in texts)
    assert sum(map(len, small.kept)) <= 5000


def test_joins_widen_until_they_agree(ranks):
    machine = bpe.Encoder(ranks)
    rng = random.Random(16)
    text = prose(rng, 400)
    raw, half = text.encode(), len(text) // 2
    left, right = (0, *machine.chunk(raw[:half])), (half, *machine.chunk(raw[half:]))
    keep, new, gone = machine.join(raw, left, right)
    assert [*left[1][:keep], *new, *right[1][gone:]] == machine.plain(text) and machine.widened == 0
    # a left chunk that is wrong about its last words: the stretch grows until the tokens agree
    spoiled = left[1].copy()
    spoiled[-40:] = 0
    keep, new, gone = machine.join(raw, (0, spoiled, *left[2:]), right)
    assert machine.widened > 3 and [*spoiled[:keep], *new, *right[1][gone:]] == machine.plain(text)
    assert machine.join(raw, (0, np.zeros_like(spoiled), *left[2:]), right) is None


def test_encoding_round_trip_on_awkward_input(spark, corpus, nothing, ranks):
    got = {r["doc_id"]: r for r in bpe.encode_documents(corpus).collect()}
    assert all(r["exact"] for r in got.values()) and got[200]["tokens"] is None and list(got[201]["tokens"]) == []
    assert bpe.encode_documents(nothing).count() == 0
    bad = spark.createDataFrame([([99_999],), ([ranks[b"\xc3"]],), (None,), ([],)], "t array<int>")
    assert [r[0] for r in bad.select(bpe.decoder(spark, ranks)(F.col("t"))).collect()] == [None, None, None, ""]


# 10
def brute_nearest(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in good:
        near = sorted((((v - w) ** 2).sum(), j) for j, w in good if j != i)[:k]
        out += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_equals_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 4
    rows = [(i, [float(np.float32(x)) if kind == "float" else float(x) for x in centres[i % 8] + rng.normal(size=6) * 0.1]) for i in range(300)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (None, rows[1][1]), (903, [1.0]), (904, [float("nan")] * 6), (905, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (906, [])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("id", F.lit("clash")).repartition(3)
    monkeypatch.setattr(topk, "DIMENSIONS", 2)
    got = sorted((r["vec_id"], r["rank"], r["neighbor_id"]) for r in topk.nearest(df, k=4, every=1).collect())
    assert got == brute_nearest(rows, 4)
    some = sorted((r["vec_id"], r["rank"], r["neighbor_id"]) for r in topk.nearest(df, k=4).collect())
    assert some == [r for r in got if r[0] % 100 == 0] and len(some) == 16
    assert topk.nearest(df.limit(0)).count() == 0
    assert topk.nearest(df.where("vec_id = 0")).count() == 0


def test_nearest_tells_doubles_apart_and_takes_whole_ids(spark):
    near = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1 + 1e-9, 0.0]), (2, [1 + 3e-9, 0.0]), (3, [1e200, 0.0]), (4, [3e19, 0.0]), (5, [3.1e19, 0.0])], "vec_id int, embedding array<double>")
    got = {r["vec_id"]: r["neighbor_id"] for r in topk.nearest(near, k=1, every=1).collect()}
    assert got == {0: 1, 1: 0, 2: 1, 4: 5, 5: 4}
    with pytest.raises(TypeError):
        topk.nearest(near.withColumn("vec_id", F.lit("a")))


def test_blocks_beyond_the_bound_are_skipped():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(50, 8)), rng.normal(size=(50, 8)) + 40]).astype(np.float32)
    best = topk.Best(np.arange(50), x[:50], 3, topk._first_bounds(np.arange(50), x[:50], np.arange(100)[::2], x[::2], 3))
    for lo in (0, 50):
        topk.search_block(best, np.arange(lo, lo + 50), np.ascontiguousarray(x[lo : lo + 50].T))
    d = ((x[:50, None, :].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert best.skipped == 1 and (best.near.reshape(50, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


def test_branch_and_bound_compacts(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(topk, "SPARSE", 0.5)
    centres = rng.normal(size=(20, 64)).astype(np.float32) * 3
    x = (centres[np.arange(600) % 20] + rng.normal(size=(600, 64)) * 0.1).astype(np.float32)
    best = topk.Best(np.arange(600), x, 5)
    for lo in range(0, 600, 100):
        topk.search_block(best, np.arange(lo, lo + 100), np.ascontiguousarray(x[lo : lo + 100].T))
    d = ((x[:, None, :].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert (best.near.reshape(600, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


# pipeline
def test_pipeline_stages(spark, tmp_path, toxic_docs):
    import corpus_pipeline

    rng = random.Random(11)
    rows = [(i, t, "en", f"s{i % 4 if i > 100 else 0}", len(t)) for i, t, _ in toxic_docs]
    rows += [(500, rows[1][1], "en", "s1", 1), (501, "key AKIA" + "B2" * 8 + " " + prose(rng, 30), "en", "s1", 1), (502, None, None, None, None), (503, "", "en", "s0", 0)]
    rows += [(504, prose(rng, 40_000), "en", None, 1), (None, prose(rng, 20), "en", "s1", 1)]
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("gone", "node", "_copy", "mix_key", "class_id", "p_toxic", "key", "id"):
        clash = clash.withColumn(name, F.lit("clash"))
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(r[0], 1, r[2]) for r in toxic_docs]).write.parquet(f"{tmp_path}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "secrets", "mixing", "bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        docs = after
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    clean = {r[0] for r in toxic_docs if not r[2]} | {501, 502, 503, 504, None}
    assert ids == clean and all(r["exact"] for r in got)
    machine = bpe.Encoder(bpe.load_ranks(bpe.vocabulary_path()))
    text = {r[0]: r[1] for r in rows} | {501: rows[-5][1].replace("AKIA" + "B2" * 8, "[secret:aws_access_key]")}
    assert all(r["tokens"] is None if text[r["doc_id"]] is None else list(r["tokens"]) == machine.plain(text[r["doc_id"]]) for r in got)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, []).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
