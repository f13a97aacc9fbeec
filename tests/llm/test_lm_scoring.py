"""Language-model scores against a plain dynamic programme and plain counts."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from seriatim.llm import lm_scoring
from seriatim.llm.queries import op11_lm_score, piece_model

ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (None, "Null id null ID"), (9004, "ab ab AB ab"), (9005, "x" * 3000 + " tail"), (9006, "naïve 漢字🙂 a▁b   ."), (9006, "naïve 漢字🙂 a▁b   ."), (9007, "z" * 70 + "\r\n" + "z" * 70)]


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [x for x in re.split(r"[\x20\x09-\x0D]+", lower) if x]


@pytest.fixture(scope="module")
def loaded():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    names = [model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return *lm_scoring.load(piece_model()), names


def plain_marginal(lattice, weight, word):
    text, log = " " + word, [0.0]
    for j in range(1, len(text) + 1):
        ways = [log[j - k] + weight[text[j - k : j]] for k in range(1, min(j, lattice.width) + 1) if text[j - k : j] in weight]
        if text[j - 1] not in weight:
            ways.append(log[j - 1] + len(text[j - 1].encode()) * lattice.weight[lattice.size])
        log.append(np.logaddexp.reduce(ways))
    return log[-1]


def test_marginals_are_sums_over_all_segmentations(loaded):
    lattice, _, names = loaded
    weight = dict(zip(names, lattice.weight))
    words = ["hello", "thtioneng", "naïve", "漢字🙂", "a", "x" * 70, "q" * 200 + "é", "zz"]
    assert np.allclose(lm_scoring.marginals(lattice, words), [plain_marginal(lattice, weight, w) for w in words])

    def every(text):  # by enumeration, for one short word
        return 1.0 if not text else sum(math.exp(weight[text[:k]]) * every(text[k:]) for k in range(1, len(text) + 1) if text[:k] in weight)

    assert math.isclose(lm_scoring.marginals(lattice, ["there"])[0], math.log(every(" there")))


def test_expected_uses_are_derivatives_of_the_marginal(loaded):
    lattice, _, _ = loaded
    for _, codes, size in lm_scoring.batches_of(["thtion", "漢b"]):
        total, uses = lm_scoring.expected(lattice, codes, size)
        for i in np.flatnonzero(uses):
            weight = lattice.weight.copy()
            weight[i] += 1e-6
            moved = lm_scoring.Lattice(lattice.keys, lattice.child, lattice.piece, lattice.single, lattice.width, weight)
            assert abs((lm_scoring.expected(moved, codes, size)[0].sum() - total.sum()) / 1e-6 - uses[i]) < 1e-3


def test_query_equals_plain_counts_and_lattice(spark, tmp_path, loaded):
    lattice, prior, names = loaded
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = real.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "1 as word", "'c' as c", "2 as key", "3 as train")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_lm_score(spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], plain_words(r["text"]) + [""]) for r in docs.collect()]
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d, _ in rows if d is not None}
    c = collections.Counter(w for d, ws in rows if d is not None and fold[d] != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    # the fit, with the marginals tested above
    mass = prior * len(prior)
    fitted = lattice
    for _ in range(lm_scoring.ROUNDS):
        mass = prior * len(prior)
        for _, codes, size in lm_scoring.batches_of([w for w in c if w]):
            mass = mass + lm_scoring.expected(fitted, codes, size)[1]
        fitted = fitted.weighed(mass)
    kinds = sorted({w for _, ws in rows for w in ws if w})
    p0 = dict(zip(kinds, lm_scoring.marginals(fitted, kinds) + math.log(1 - lm_scoring.END))) | {"": math.log(lm_scoring.END)}

    def model(w):
        back = math.log(v + 1) + p0[w]
        return (math.log(c[w] + math.exp(back)) if c[w] else back) / math.log(10) - math.log10(n + v + 1)

    want = sorted((-1 if d is None else d, len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 5), round(sum(p0[w] for w in ws) / math.log(10), 3), round(sum(map(model, ws)), 3), d is not None and fold[d] == 1) for d, ws in rows)
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["lattice_score"], 3), round(r["score"], 3), r["held_out"]) for r in got)
    assert len(have) == len(want) and {r["train_tokens"] for r in got} == {n}
    for a, b in zip(have, want):
        assert a[:3] == b[:3] and a[6] == b[6] and np.allclose(a[3:6], b[3:6], rtol=1e-6, atol=2e-3), (a, b)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["lattice_score"] for r in held)  # what was learned helps on rows it was not learned from


def test_tables_without_rows_or_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    from pyspark.sql import functions as F

    assert lm_scoring.score(none, F.lit(True), piece_model()).count() == 0
    (row,) = lm_scoring.score(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), F.lit(False), piece_model()).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and abs(row["base_score"]) < 1e-9 and row["score"] < 0
