"""Each operator against a brute-force version, a library or a round trip, with odd rows among ordinary ones."""

import base64
import collections
import gzip
import hashlib
import json
import math
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriatim.llm import decontaminate, exact_topk, language_id, minhash_dedup, quality_classifier, secret_scan, sentence_piece, suffix_dedup, toxicity, warc
from seriatim.llm._spark import CLEANUP_CONF, bounded_rows, shared_dir
from seriatim.llm.queries import op9_suffix, piece_model

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(9001, None, "en", None, None), (9002, "", None, "s", 0), (9003, " \t\n", "fr", "s", 3), (None, "null id " * 40, None, None, 5), (9004, "ab", "en", "s", 2), (9005, "x" * 3000, "en", "s", 3000), (9006, "12 345 !?", "de", "s", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([*ODD, ODD[3], ODD[5]], DOCS)  # two rows twice
    return real.unionByName(odd).withColumns({"score": F.lit(1), "key": F.lit("clash"), "node": F.lit(2), "label": F.lit("x")}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    odd = spark.createDataFrame([(9001, 1, None), (None, 0, 1), (9004, None, 0), (9004, 1, 1)], "doc_id long, quality int, toxic int")
    return spark.read.parquet(f"{SF}/labels.parquet").unionByName(odd)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_quality_learns_and_scores_every_row(spark, docs, labels, rows):
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    known = [(truth[r["doc_id"]], r["score"]) for r in got if r["doc_id"] in truth and r["held_out"]]
    assert sum((s >= 0.3) == y for y, s in known) / len(known) > 0.8
    assert quality_classifier.classify(empty(spark), labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_finds_passages(spark, docs, labels, rows):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(empty(spark), labels).count() == 0
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("same", [True, False])
def test_fits_are_bounded_by_rows(spark, same):
    text = F.lit("one text") if same else F.concat(F.lit("text "), F.col("id").cast("string"))
    many = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), text.alias("text"), F.lit(1).alias("label"))
    rows = many.unionByName(spark.createDataFrame([(2, None, 0), (None, "x", 1)], "doc_id long, text string, label int"))
    got = bounded_rows(rows, 50)
    assert got.count() == (3 if same else 50) and set(got.columns) == {"doc_id", "text", "label", "pick"}
    assert bounded_rows(rows.limit(0), 50).count() == 0


def test_maximal_segments_are_those_of_the_definition():
    rng = np.random.default_rng(1)

    def brute(x):
        if not len(x):
            return []
        total = np.concatenate([[0], np.cumsum(x)])
        value, i, j = max(((total[j] - total[i], -(j - i), -i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1))
        if value[0] <= 0:
            return []
        return [*brute(x[:i]), (i, j)] + [(a + j, b + j) for a, b in brute(x[j:])]

    for _ in range(200):
        x = rng.integers(-5, 6, rng.integers(0, 14)).astype(float) + rng.uniform(0, 0.01)
        x = x + rng.uniform(-0.01, 0.01, len(x))
        got = [(s, e) for s, e, _ in toxicity.maximal_segments(x)]
        # same segments after trimming the non-positive ends that both may hold
        assert got == brute(x), x


def der(tag, *parts):
    body = b"".join(parts)
    n = bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2)
    return bytes([tag]) + n + body


def field(raw):
    return len(raw).to_bytes(4) + raw


NUMBER = der(2, b"\x11" * 32)
ED25519 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, b"\x07" * 32)))
OPENSSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4) + field(field(b"ssh-ed25519") + field(b"\x07" * 32)) + field(b"\x01" * 136)


def test_only_private_keys_are_secrets():
    oid = der(0x30, der(6, bytes.fromhex("2a864886f70d010101")), b"\x05\0")
    private = {
        "der": [ED25519, der(0x30, der(2, b"\0"), *[NUMBER] * 8), der(0x30, der(2, b"\1"), der(4, b"\x09" * 32), der(0xA0, der(6, b"\x2b\x81\x04\0\x0a"))),
                der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, NUMBER)), der(4, b"\x05" * 48))],
        "ssh": [OPENSSH],
    }
    public = [der(0x30, oid, der(3, b"\0" + der(0x30, NUMBER, NUMBER))), der(0x30, NUMBER, NUMBER), der(0x30, der(0x30, der(0xA0, der(2, b"\2")), NUMBER, oid), oid, der(3, b"\0" * 40)), field(b"ssh-ed25519") + field(b"\x07" * 32)]
    for kind, raws in private.items():
        for raw in raws:
            forms = [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).rstrip(b"=").decode(), raw.hex().upper()]
            for text in forms:
                assert [s for s in secret_scan.spans_of(f"x {text} y") if s[2] == kind] == [(2, 2 + len(text), kind)], (kind, text)
            assert not [s for s in secret_scan.spans_of(f"x {base64.b64encode(raw[:-1]).decode()} y") if s[2] in ("der", "ssh")]
    for raw in public:
        for label in ("CERTIFICATE", "PUBLIC KEY"):
            text = f"-----BEGIN {label}-----\n{base64.b64encode(raw).decode()}\n-----END {label}----- and {base64.b64encode(raw).decode()}"
            assert not [s for s in secret_scan.spans_of(text) if s[2] in ("der", "ssh")], label
    old = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + base64.b64encode(b"\x5a" * 64).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert [s[2] for s in secret_scan.spans_of(old)] == ["der"]
    assert secret_scan.spans_of("-----BEGIN A-----" + " " * 200_000) == []


def test_secrets_match_the_base_rule_and_confirm_structures(spark, docs, rows):
    def base(text):
        found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
        found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        order = ["assign", "access", "hex"]
        return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(found, key=lambda s: (s[0], order.index(s[2]))))

    want = collections.Counter((i, hashlib.sha256(base(t or "").encode()).hexdigest()) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in secret_scan.scan(docs).collect()) == want
    b64 = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
    jwt = f"{b64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{b64(json.dumps({'sub': '1'}).encode())}.abcDEF_123"
    der = base64.b64encode(ED25519).decode()
    ssh = base64.b64encode(OPENSSH).decode()
    spans = secret_scan.spans_of(f"é {jwt} and {der} and {ssh} but not {der[:-8]}")
    assert [s[2] for s in spans] == ["jwt", "der", "ssh"] and spans[0][:2] == (2, 2 + len(jwt))
    assert [s[2] for s in secret_scan.spans_of("token=secret=abc password : abcdefghijkl1234")] == ["assign"]
    assert secret_scan.redacted("a token=abcdef0123456789abcdef z", secret_scan.spans_of("a token=abcdef0123456789abcdef z")) == "a [assign] z"
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.scan(empty(spark)).count() == 0


def test_encrypted_tokens_and_keys_over_lines_without_marks_are_secrets():
    b64 = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
    head = b64(b'{"alg":"RSA-OAEP","enc":"A256GCM"}')
    for parts in ([head, b64(b"\x81" * 40), b64(b"\x82" * 12), b64(b"\x83" * 30), b64(b"\x84" * 16)], [b64(b'{"alg":"dir","enc":"A128GCM"}'), "", b64(b"\x82" * 12), b64(b"\x83"), b64(b"\x84" * 16)]):
        token = ".".join(parts)
        assert secret_scan.spans_of(f"cookie.{token}, then") == [(7, 7 + len(token), "jwt")]
        assert secret_scan.spans_of(".".join([b64(b'{"alg":"dir"}') + "abcdef", *parts[1:]])) == [] and secret_scan.spans_of(".".join(parts[:4])) == []
    rsa = der(0x30, der(2, b"\0"), *[NUMBER] * 8)
    whole = der(0x30, der(2, b"\0"), *[NUMBER] * 7, der(2, b"\x11" * 60))
    for kind, raw in (("der", ED25519), ("der", rsa), ("der", whole), ("ssh", OPENSSH)):
        text = base64.b64encode(raw).decode()
        for width in (32, 48, 64, 76, len(text) // 2 + len(text) % 2):
            if len(text) <= width or kind == "ssh" and (width < 48 or len(text) % width == 0):
                continue
            for end in ("\n", "\r\n", "\n    ", "\\n"):
                key = end.join(text[k : k + width] for k in range(0, len(text), width))
                for after in ("", "\n", "\n\nhello", "\nhello there", f"\n{'A' * width}"):
                    if kind == "ssh" and len(text) % width == 0:
                        continue
                    got = [s for s in secret_scan.spans_of(f"key: {key}{after}") if s[2] in ("der", "ssh")]
                    assert got == [(5, 5 + len(key), kind)], (kind, width, end, after)
            assert not secret_scan.spans_of(f"key: {key[:-8]}\nhello")
    public = base64.b64encode(der(0x30, NUMBER, NUMBER, NUMBER)).decode()
    assert secret_scan.spans_of("\n".join(public[k : k + 64] for k in range(0, len(public), 64))) == []
    blocks = f"-----BEGIN PUBLIC KEY-----\n{public}\n-----END PUBLIC KEY-----\n" * 3000
    assert secret_scan.spans_of(blocks + base64.b64encode(ED25519).decode())[0][2] == "der"


def test_rows_of_different_texts_get_keys_of_their_own(spark):
    rows = [(1, "a" * 9), (1, "a" * 9), (2, "b"), (3, None), (4, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed, twins = suffix_dedup.known_by_hash(docs, lambda salt: (suffix_dedup.row_key(0) * 0 if salt == 0 else F.pmod(suffix_dedup.row_key(salt), F.lit(2)) if salt == 1 else suffix_dedup.row_key(salt)))
    by_key = collections.defaultdict(set)
    for r in keyed.collect():
        by_key[r["key"]].add(r["text"])
    assert all(len(texts) == 1 for texts in by_key.values()) and sum(r["n"] for r in twins.collect()) == len(rows)


def test_items_without_an_id_are_searched_too(spark):
    question = "which of the seven small rivers of the northern valley froze last winter before the old bridge fell? The answer is the river under the mill near the eastern gate."
    docs = spark.createDataFrame([(1, f"some words before {question} and some after"), (2, "nothing of the kind")], "doc_id long, text string")
    items = spark.createDataFrame([(None, question), (7, question), (None, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect() if r["item_id"]) == [(1, 7)]
    alone = items.where("item_id is null")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, alone).collect()] == [(1, None)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, alone).collect()] == [2]


def test_tokens_after_words_and_keys_with_escaped_lines_are_secrets():
    b64 = lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"=").decode()
    body = f"{b64(b'{"sub": "1"}')}.abcDEF_123"
    plain, spaced, indented = (f"{b64(head)}.{body}" for head in (b'{"alg": "HS256"}', b'{ "alg": "HS256"}', b'{\n  "alg": "HS256"}'))
    assert spaced.startswith("eyAi") and indented.startswith("ewog")
    for token in (plain, spaced, b64(b'{\n "alg": "HS256"}') + "." + b64(b'{\n "sub": "1"}') + ".abc"):
        assert secret_scan.spans_of(token) == [(0, len(token), "jwt")]
    text = f"credentials.{plain} and elephants.credentials.{indented}."
    assert [(text[a:b], k) for a, b, k in secret_scan.spans_of(text)] == [(plain, "jwt"), (indented, "jwt")]
    der = base64.b64encode(ED25519).decode()
    for end in ("\n", "\\n", "\\r\\n"):
        pem = end.join(["-----BEGIN PRIVATE KEY-----", der[:40], der[40:], "-----END PRIVATE KEY-----"])
        assert secret_scan.spans_of(f'"{pem}{end}"') == [(1, 1 + len(pem), "der")]


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_the_brute_force_components(spark, docs, rows, width):
    base = " ".join(f"w{i}" for i in range(120))
    family = [(7000 + k, base.replace(f"w{7 * k} ", "edited ").replace(f"w{7 * k + 60} ", "again "), "en", "s", 1) for k in range(12)]
    docs = docs.unionByName(spark.createDataFrame(family, DOCS), allowMissingColumns=True)
    rows = rows + [(r[0], r[1]) for r in family]
    sets = {i: shingle_set(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    got = minhash_dedup.near_duplicates(docs, width).collect()
    want = collections.Counter((i, len(shingle_set(t, width)), None if i is None else find(i), i is not None and find(i) == i) for i, t in rows)
    assert collections.Counter(map(tuple, got)) == want
    if width == 5:
        kept = minhash_dedup.keep_one(docs)
        assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {i for i, _, _, k in want if k or i is None}
        assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_one_row_stays_of_those_with_equal_id_and_text(spark):
    long_ = " ".join(f"w{k}" for k in range(60))
    data = [(5, long_, "b"), (5, long_, "a"), (5, long_, "c"), (6, long_, "a"), (None, "no id", "z"), (None, "no id", "y"), (None, "other", "y"), (None, None, "q"), (None, None, "p"), (8, "alone", "x"), (9, "", "k"), (9, "", "k")]
    got = minhash_dedup.keep_one(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    want = [(5, long_, "a"), (None, "no id", "y"), (None, "other", "y"), (None, None, "p"), (8, "alone", "x"), (9, "", "k")]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (55, 55)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash_dedup.components(edges, "t").collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100}


def test_decontamination_finds_whole_items(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    leak = [(8000 + k, f"start here {t.upper()} and on", "en", "s", 1) for k, t in list(texts.items())[:5]]
    odd = items.unionByName(spark.createDataFrame([(901, None), (902, ""), (903, "one"), (None, "no id here at all")], "item_id long, text string"))
    both = docs.unionByName(spark.createDataFrame(leak, DOCS), allowMissingColumns=True)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(both, odd).collect()}
    assert {(8000 + k, k) for k in list(texts)[:5]} <= got
    clean = {(r["doc_id"], i) for r in docs.collect() for i, t in texts.items() if t in (r["text"] or "")}
    assert clean <= got
    words = lambda t: set(zip(*(re.findall(r"[^\W_]+", t.lower())[k:] for k in range(3))))
    whole = {r["doc_id"]: words(r["text"] or "") for r in both.collect()}
    assert all(len(words(texts[i]) & whole[d]) >= 0.4 * len(words(texts[i])) for d, i in got)
    kept = decontaminate.clean(both, odd)
    assert kept.columns == both.columns and kept.count() == both.count() - both.where(F.col("doc_id").isin([d for d, _ in got])).count()
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0 and decontaminate.contaminated(empty(spark), items).count() == 0


def test_block_max_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [" ".join(rng.choice(vocabulary, rng.integers(3, 90))) for _ in range(150)]
    index = decontaminate.build(list(range(150)), items)
    texts = [" ".join(rng.choice(vocabulary, 100)) + " " + items[k] for k in range(0, 150, 10)]
    h, first = decontaminate.words(pa.array(texts))
    got = {(t, i): s for t, i, s in zip(*(x.tolist() for x in decontaminate.retrieved(index, h, first)))}
    place = {x: k for k, x in enumerate(index.terms.tolist())}
    want = {}
    for t in range(len(texts)):
        own = h[first[t] : first[t + 1]].tolist()
        for at in range(0, len(own), 32):
            score = np.zeros(len(index.segment_item))
            for term in {place[x] for x in own[at : at + 64] if x in place}:
                a, b = index.first[term], index.first[term + 1]
                score[index.segment[a:b]] += index.impact[a:b]
            for s in np.flatnonzero(score >= decontaminate.THRESHOLD):
                key = (t, int(index.segment_item[s]))
                want[key] = max(want.get(key, 0), score[s])
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_language_is_learned_from_the_other_fold(spark, docs, rows):
    filters = language_id.fit(docs)
    got = language_id.predict(docs, filters).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by_id[i] == "und" for i in (9001, 9002, 9003, 9006))
    truth = {r["doc_id"]: r["lang"] for r in docs.where("lang is not null and doc_id < 9000").collect()}
    assert sum(by_id[i] == x for i, x in truth.items()) / len(truth) > 0.97
    kept = language_id.keep_known(docs, filters)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in got)
    assert language_id.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs, None).collect()} == {"und"}


def test_texts_in_an_unlearned_script_go(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [(7001, "Быстрая коричневая лиса прыгает. " * 9, None), (7002, "今日はとても良い天気ですね。散歩に行きましょう。", "en"), (7003, "Η γρήγορη καφέ αλεπού", None), (7004, "Б", "de"), (7005, "Быстрая лиса of the " + "прыгает через собаку " * 20, None)]
    both = real.unionByName(spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in odd], DOCS))
    filters = language_id.fit(real)
    kept = language_id.keep_known(both, filters, language_id.least_share(real, filters))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in real.collect())
    assert language_id.least_share(empty(spark), None) == 0 and language_id.keep_known(both, None).count() == 0


def test_archives_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = [(5001, None, None), (5002, "http://a b/\n", ""), (5003, "http://x/", "a\r\n\r\nWARC/1.0\r\n é"), (5004, "http://y/", "a\r\n\r\nWARC/1.0\r\n é"), (5004, "http://y/", "a\r\n\r\nWARC/1.0\r\n é")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string, html string")).withColumn("payload", F.lit(1))
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    top = {}
    for i, raw in rows:
        top[raw] = max(top.get(raw, i), i)
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    digest = {i: base64.b32encode(hashlib.sha1(raw).digest()).decode() for i, raw in rows}
    raws = dict(rows)
    for r in got:
        i = r["page_id"]
        assert r["payload_digest"] == digest[i] and r["payload_bytes"] == len(raws[i])
        if i != 5004:
            assert (r["record_type"], r["refers_to"]) == (("response", None) if top[raws[i]] == i else ("revisit", top[raws[i]]))
    assert sorted(r["record_type"] for r in got if r["page_id"] == 5004) == ["response", "revisit"]
    assert warc.archive(pages.limit(0)).count() == 0


def test_arc_versions_and_truncation():
    import io

    for version in (1, 2):
        raw = "\n".join(warc.arc_lines(0, iter([(1, "http://a/", "one"), (2, "http://b/", "two\n\nlines")]), version)) + "\n"
        got = list(warc.arc_records(io.BufferedReader(io.BytesIO(raw.encode()))))
        assert [warc.http_parts(c)[1] for _, c in got[1:]] == [b"one", b"two\n\nlines"] and got[1][0]["URL"] == "http://a/"
        # the record that ends early counts as damaged
        assert [bool(h) for h, _ in warc.arc_records(io.BufferedReader(io.BytesIO(raw.encode()[:-8])))] == [True, True, False]


def test_records_of_a_wrong_length_are_left_out_alone():
    import io

    head = b"http://%d/ 10.0.0.1 2001010100000%d text/html %d\n"
    bodies = [b"body %d " % i + b"of some length\nand lines\n" * 6 for i in range(6)]
    for off in (10**6, 60, -20, -2, 1, -26):
        raw = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain 0\n\n" + b"".join(head % (i, i, len(b) + off * (i == 1)) + b + b"\n" for i, b in enumerate(bodies))
        got = list(warc.arc_records(io.BufferedReader(io.BytesIO(raw))))[1:]
        assert [c for h, c in got if h] == [b for i, b in enumerate(bodies) if i != 1] and sum(not h for h, _ in got) == 1, off


def test_foreign_arc_files_keep_every_readable_record(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    latin = http + "caf\xe9 ".encode("latin-1") * 5
    about = b"1 0 elsewhere\nURL IP-address Archive-date Content-type Archive-length\n"
    records = [
        (b"http://a/ 10.0.0.1 20010101000000 text/html; charset=utf-8", http + b"first"),
        (b"http://b/with space 10.0.0.2 20010102000000 text/html", latin),
        (b"http://c/ 10.0.0.3 notadate text/html", latin),
        (b"filedesc://in-the-middle 10.0.0.4 20010103000000 text/html", http + b"odd"),
        (b"ftp://d/x 10.0.0.5 20010104000000 image/png", b"\x89PNG\0\xff" * 9),
    ]
    whole = b"filedesc://x.arc 0.0.0.0 20010101000000 text/plain %d\n%s\n" % (len(about), about) + b"".join(b"%s %d\n%s\n" % (head, len(body), body) for head, body in records)
    broken = whole.replace(b"first\n", b"first and more than declared\nlines\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc").write_bytes(whole)
    (tmp_path / "in/b.arc").write_bytes(broken)
    assert warc.convert(spark, f"{tmp_path}/in", f"{tmp_path}/out") == 1
    assert warc.damaged(spark, f"{tmp_path}/in/a.arc") == 0 and warc.damaged(spark, f"{tmp_path}/in/b.arc") == 1
    got = warc.read_warc(spark, f"{tmp_path}/out").collect()
    digests = lambda raw: base64.b32encode(hashlib.sha1(raw).digest()).decode()
    want = collections.Counter({digests(b"first"): 1, digests(latin[len(http) :]): 4, digests(b"odd"): 2})
    assert collections.Counter(r["payload_digest"] for r in got) == want
    assert {r["payload_bytes"] for r in got if r["payload_digest"] == digests(latin[len(http) :])} == {len(latin) - len(http)}
    assert sum(r["record_type"] == "response" for r in got) == 3
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.gz"))
    assert raw.count(latin) == 1 and b"WARC-IP-Address: 10.0.0.2" in raw and b"Content-Type: image/png" in raw and b"WARC-Date: 1970-01-01T00:00:00Z" in raw
    ids = set(re.findall(rb"WARC-Record-ID: (\S+)", raw))
    refers = re.findall(rb"WARC-Refers-To: (\S+)", raw)
    assert len(refers) == 4 and set(refers) <= ids


def test_repeats_are_those_of_all_windows(spark, docs, rows):
    shared = "".join(chr(97 + int(x)) for x in np.random.default_rng(4).integers(0, 26, 900))
    extra = [(6000, "aa " + shared[:450] + "bb"), (6001, "c" + shared + "d"), (6002, shared[300:760]), (6003, "x" + shared[450:]), (6004, "go " * 500), (6005, "go " * 120 + "stop " * 130), (6006, "go " * 120 + "stop " * 130 + "é")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in extra], DOCS), allowMissingColumns=True)
    rows = rows + extra
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(raw[p : p + 400] for raw in raws for p in range(len(raw) - 399))
    want = collections.Counter()
    for (i, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 399):
            if seen[raw[p : p + 400]] > 1:
                gone[p : p + 400] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        want[i, len(raw), int(gone.sum()), len(edge), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()] += 1
    assert collections.Counter(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_give_kept_texts_and_spans(spark, tmp_path):
    shared = "".join(chr(97 + int(x)) for x in np.random.default_rng(6).integers(0, 26, 500))
    short = shared[::-1][:390]  # over 50 words would do, but not under 400 bytes
    # the letters before and after share a byte, so the repeat begins and ends within a letter
    rows = [(1, f"x\u00e9{shared}\u00e9 end"), (2, f"y\u00a9{shared}\u00e8{short}"), (3, short), (4, None), (5, f"{shared[:400]}-{shared[:400]}"), (6, "same " * 90), (6, "same " * 90), (7, "caf\u00e9")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    kept = {r["doc_id"]: r for r in suffix_dedup.kept_texts(docs).collect()}
    assert [tuple(map(tuple, kept[i]["spans"])) for i in range(1, 8)] == [((2, 504),), ((2, 504),), (), (), ((0, 400), (401, 801)), ((0, 450),), ()]
    assert [kept[i]["kept_text"] for i in range(1, 8)] == ["x end", "y" + short, short, "", "-", "", "caf\u00e9"]
    assert kept[1]["kept"] == b"x\xc3\xa9 end" and kept[2]["kept"] == b"y\xc2\xa8" + short.encode() and kept[7]["kept"] == "caf\u00e9".encode()
    got = op9_suffix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [tuple(map(int, x.split(":"))) for x in r["removed_spans"].split(",") if x]
        assert r["kept_text"] == kept[r["doc_id"]]["kept_text"] and spans == list(map(tuple, kept[r["doc_id"]]["spans"]))
        assert (r["n_removed"], r["n_spans"], r["repeated"]) == (sum(e - s for s, e in spans), len(spans), bool(spans))
        assert r["kept_sha256"] == hashlib.sha256(kept[r["doc_id"]]["kept"]).hexdigest() and {r["n_bytes"]} == {len(t.encode()) for t in texts[r["doc_id"]]}


def test_repeats_leave_no_tables_or_shuffle_files_behind(spark, docs):
    docs.count()
    before = spark.conf.get(CLEANUP_CONF)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x.rsplit("/", 1)[1] for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    tables = lambda: {f.parent for f in Path(shared_dir(spark).removeprefix("file:")).rglob("repeat-*/**/*.parquet")}
    had, made = tables(), shuffles()
    got = suffix_dedup.remove_repeats(docs)
    assert {d.name.rsplit("-", 1)[0] for d in tables() - had} == {"repeat-texts", "repeat-removed"}  # what the result reads
    for _ in range(40):  # files are deleted beside the query
        if shuffles() <= made:
            break
        time.sleep(0.25)
    assert shuffles() <= made and spark.conf.get(CLEANUP_CONF) == before
    assert sorted(map(str, got.collect())) == sorted(map(str, got.collect()))  # reads nothing that is gone


def test_queries_beside_every_group_are_not_broadcast(spark, monkeypatch):
    """Tables are small here, so any join that the optimizer is left alone with is a broadcast."""
    monkeypatch.setattr(exact_topk, "GROUP", 20)
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0)
    assert got.count() == 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8).round(2)]) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(60)]
    odd = [(2000, None), (2050, [1.0, float("nan")] + [0.0] * 6), (None, [1.0] * 8), (2100, [None] + [1.0] * 7), (2150, [1.0, 2.0]), (2151, [3.0, 1e19]), (50, [0.1] * 8)]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in data + odd if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = collections.defaultdict(list)
    for r in exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for i, v in ok:
        if i % 50 == 0 and i != 50:
            want = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v)))[:5]
            assert got[i] == [(j, max(-(2**63), min(2**63 - 1, -s))) for s, j in want]
    assert exact_topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pieces_are_the_librarys(spark, docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = [t for _, t in rows] + ["a  b ", "日本語 текст 😀", "\x00▁x", "ababab" * 40, "internationalization" * 3]
    v = sentence_piece.load(piece_model())
    ids, first = sentence_piece.encode_texts(v, texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [model.encode(t or "") for t in texts]
    assert sentence_piece.decode_ids(v, ids, first) == [(t or "").replace("▁", " ") for t in texts]
    got = sentence_piece.encode(docs, piece_model()).collect()
    assert collections.Counter((r["doc_id"], r["decoded"]) for r in got) == collections.Counter(rows)
    assert all(r["round_trip"] for r in sentence_piece.digests(docs, piece_model()).collect())
    assert sentence_piece.encode(empty(spark), piece_model()).count() == 0


def test_pair_rule_is_merging():
    pieces = ["a", "b", "c", "ab", "bc", "abc", "aa", "ca", "aab"]
    v = sentence_piece.prepared(pieces, -np.arange(len(pieces), dtype=float), [p.encode() for p in pieces], np.full(256, -1))
    ids = {p: i for i, p in enumerate(pieces)}
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        parts = list(text)
        while True:
            best = max(((v.score[ids[x + y]], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ids), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        got, first = sentence_piece.encode_segments(v, [text])
        assert [pieces[i] for i in got] == parts


def test_a_hundred_languages_fit(spark):
    rng = np.random.default_rng(8)
    names = [f"l{k:03d}" for k in range(100)]
    words = {x: ["".join(chr(0x3400 + 40 * k + c) for c in rng.integers(0, 40, 4)) for _ in range(30)] for k, x in enumerate(names)}
    rows = [(1000 * k + i, " ".join(rng.choice(words[x], 25)), x) for k, x in enumerate(names) for i in range(6 if k else 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.fit(docs, 300)
    assert filters.slots.shape[0] == 2 and filters.languages == names
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, filters).collect()}
    assert sum(got[i] == x for i, _, x in rows) / len(rows) > 0.99
    # equal counts: the language that sorts first
    tie = language_id.build(["a", "b"], [np.array([1], np.uint64)] * 2)
    assert language_id.decided(tie, ["xyz"])[0] == ["a"]


def test_scores_do_not_depend_on_shards(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "SHARD", 7)
    cut = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert len(whole) > 2 and [r[:2] for r in whole] == [r[:2] for r in cut] and np.allclose([r[2:] for r in whole], [r[2:] for r in cut])


def test_very_long_texts_are_taken_whole(spark):
    rng = np.random.default_rng(9)
    long_ = " ".join(f"word{k}" for k in rng.integers(0, 9000, 60_000))
    rows = [(1, long_ + " one", "en"), (2, long_ + " two", "en"), (3, "short text of words", "en"), (4, "x" * 400_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    gone = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert gone[1][1] == gone[2][1] == len(long_) + 1 and gone[3][1] == 0 and gone[4] == (400_000, 400_000)
    assert all(r["round_trip"] for r in sentence_piece.digests(docs, piece_model()).collect())
    assert secret_scan.spans_of(long_ + " token=abcdefghijkl")[-1][2] == "assign"
    items = spark.createDataFrame([(5, long_[-300:] + " two")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()) == [1, 2]
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.build(["en"], [np.zeros(0, np.uint64)])).collect()} == {"en"}
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in (1, 2, 3, 4)], "doc_id long, quality int, toxic int")
    for got in (quality_classifier.classify(docs, labels), toxicity.classify(docs, labels)):
        assert sorted(r["doc_id"] for r in got.collect() if 0 <= r["score"] <= 1) == [1, 2, 3, 4]
    pages = spark.createDataFrame([(1, "http://a/", long_), (2, "http://b/", long_)], "page_id long, url string, html string")
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc.archive(pages).orderBy("page_id").collect()] == [(1, len(long_), 2), (2, len(long_), None)]


def plain_pipeline(rows, items, learned):
    """What the stages keep, by plain rules: (doc_id, text) lists after each of the first four."""
    stages = []
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "") and r[0] not in learned]
    stages.append(rows)
    sets = [(i, shingle_set(t, 5)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[k + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    rows = sorted({r for r in rows if find(r[0]) == r[0]})
    stages.append(rows)

    def grams(words):
        return {tuple(words[k : k + 3]) for k in range(len(words) - 2)}

    def split(text):
        return re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text.lower())

    rules = []
    for text in items:
        sentences = [s for s in re.split(r"(?<=[.!?。])\s+", text.strip()) if s]
        words = split(text)
        tail = max(3, len(split(sentences[-1])) if len(sentences) > 1 else len(words) // 3)
        cut = max(len(words) - tail, 0)
        rules.append((grams(words[: max(cut, 3)]), grams(words[cut:])))
    rows = [(i, t) for i, t in rows if not any(q and a and 2 * len(q & g) >= len(q) and 2 * len(a & g) >= len(a) for g in [grams(split(t))] for q, a in rules)]
    stages.append(rows)
    kinds = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    out = []
    for i, text in rows:
        mark = [None] * len(text)
        for kind in ("hex", "access", "assign"):
            for m in re.finditer(kinds[kind], text):
                if len(m[2] if kind == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                    mark[m.start() : m.end()] = [(kind, m.start())] * (m.end() - m.start())
        new, last = [], None
        for c, k in zip(text, mark):
            if k is None:
                new.append(c)
            elif last is None:
                new.append(f"[{k[0]}]")
            last = k
        out.append((i, "".join(new)))
    stages.append(out)
    return stages


def test_pipeline_keeps_what_plain_rules_keep(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    real = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = " ".join(f"word{k}" for k in range(300))
    extra = [
        (90001, words, "en"), (90002, words, "fr"), (90003, words.replace("word150", "other"), None), (90003, words.replace("word150", "other"), None),
        (90010, "Быстрая коричневая лиса прыгает через собаку. " * 5, None), (90011, None, "en"), (90012, "", None), (90013, "12 -- 34", "en"),
        (90020, f"and so {items[0]} it goes", "en"), (90021, f"the key is token={'Ab3' * 6} and {'0123456789abcdef' * 2} here", "en"),
        (90030, " ".join(f"long{k % 977} text{k}" for k in range(20_000)), "en"),
    ]
    docs = real.unionByName(spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in extra], DOCS)).withColumns({"node": F.lit(1), "post": F.lit("p"), "component": F.lit(None).cast("string")})
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline([(r["doc_id"], r["text"]) for r in docs.collect()], items, {90010})
    assert not {90002, 90003} & {i for i, _ in want[1]} and 90020 not in dict(want[2]) and "[assign]" in dict(want[3])[90021]
    got = docs
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want):
        got = stage(spark, got, str(tmp_path))
        assert got.columns == docs.columns, name
        got = spark.createDataFrame(got.collect(), docs.schema)
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted(rows), name
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    ids = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in ids) == sorted((i, len(x), x) for i, x in ((i, model.encode(t)) for i, t in want[3]))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_language_threshold_is_a_quantile_of_every_text(spark):
    """Each rank of whole, equal and close shares is found; the fold is read as a whole, however many rows it has."""
    from seriatim.llm import language_id

    rng = np.random.default_rng(3)
    shares = np.concatenate([rng.random(3000), np.full(500, 0.25), 0.5 + 1e-13 * np.arange(40), [0.0, 1.0, 1.0]])
    df = spark.createDataFrame([(float(x),) for x in shares], "share double").cache()
    for q in (0.0, 0.001, 0.2501, 0.3, 0.6, 0.605, 1.0):
        assert language_id.lower_quantile(df, q) == np.quantile(shares, q, method="lower")
    assert language_id.lower_quantile(df.limit(0), 0.5) is None
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("words").alias("text"), F.lit("en").alias("lang"))
    assert language_id.labelled(many).count() > 12_500
