"""Cases that single operators must get right: order of notices, letters, switches, a ledger that is kept."""

import collections
import itertools
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from panelcast.llm import language_id, license_scan, near_dedup, quality_model, secret_scan
from panelcast.llm.common import table
from panelcast.session import scratch_path

DOCS = "doc_id long, text string, hits int, w int, size int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, i, i, i) for i, t in enumerate(texts)], DOCS)


# --- license scans ----------------------------------------------------------

def test_notices_count_in_their_order_only(spark):
    cc, bsd = license_scan.NOTICES[7][0], license_scan.NOTICES[9][0]
    mit = license_scan.WHOLE[0][0]
    words = license_scan.word_list(mit)
    pairs_back = "attribution noncommercial commons attribution creative commons a creative under a licensed under"
    texts = [cc, bsd, " ".join(reversed(cc.split())), pairs_back, " ".join(reversed(bsd.split())), mit,
             " ".join(words[5:40] + ["here", "goes"] + words[40:60] + words[62:]),  # two words more, two words less
             " ".join(bsd.split()[6:] + bsd.split()[:6]),  # the halves change places
             " ".join(x for i in range(0, len(words), 3) for x in [*words[i:i + 3], *["pad"] * 3]),  # torn apart
             None, "", "mit", "MIT\nLicense and General -- Public License. apache license " * 3]
    got = {r.doc_id: r for r in license_scan.query(spark, docs_of(spark, texts)).collect()}
    assert [got[i].labels for i in range(2)] == ["cc-by-nc", "bsd"] and got[0].score == got[1].score == 1.0
    assert all(got[i].labels == "" and got[i].score == 0 for i in (2, 3, 4, 7, 8, 9, 10, 11))
    assert got[5].labels == "mit" and got[5].score == 1.0
    assert got[6].labels == "mit" and 0.7 <= got[6].score < 1
    assert (got[12].n_base, got[12].first_word, got[12].base_labels) == (9, 0, "apache,gpl,mit")
    assert license_scan.query(spark, docs_of(spark, ["x"]).limit(0)).collect() == []


def test_rows_that_repeat_are_scanned_each(spark):
    docs = docs_of(spark, ["the mit license"])
    assert len(license_scan.query(spark, docs.unionByName(docs)).collect()) == 2


# --- language identification -----------------------------------------------

def test_numbers_are_no_letters(spark):
    got = language_id.predict(docs_of(spark, ["² ½ ① Ⅷ", "Ⅷ a", "12_3"]), language_id.Field(
        ["en"], {}, np.zeros((language_id.BUCKETS + 2, 1)), np.zeros((1, 1)), np.zeros(1))).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.key)] == ["und", "en", "und"]
    assert language_id.pieces_of("x²y Ⅷ ßé") == ["x", "y", "ßé"]


def test_forward_backward_is_the_sum_over_all_labellings():
    rng = np.random.default_rng(4)
    emit, move, start = rng.random((1, 4, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    node, pairs = language_id.posteriors(emit, move, start)
    want, moves, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        p = start[path[0]] * np.prod([emit[0, t, x] for t, x in enumerate(path)]) * np.prod(
            [move[a, b] for a, b in zip(path, path[1:])])
        total += p
        for t, x in enumerate(path):
            want[t, x] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
    assert np.allclose(node[0], want / total) and np.allclose(pairs, moves / total)
    sums = language_id.text_posteriors([np.arange(4)], emit[0].astype(np.float32), move, start)
    assert np.allclose(sums[0], want.sum(axis=0) / total, atol=1e-4)


def test_training_sees_switches():
    segments = [(np.arange(40) + 100 * i, np.full(40, i % 2)) for i in range(80)]
    mixed = language_id._joined(segments, 0)
    assert 2 <= len(mixed) <= 10
    assert all(len(w) == len(g) == 40 and set(g) == {0, 1} and (g[0] == (w[0] // 100) % 2) for w, g in mixed)


# --- quality ------------------------------------------------------------------

def test_weights_solve_the_ridge_and_calibration_is_unseen(spark):
    docs, labels = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")
    stats = quality_model.statistics(docs)
    m = quality_model.fit(stats, labels, F.lit(True))
    rows = stats.join(labels, stats["key"] == labels["doc_id"]).where("quality is not null")
    rows = rows.withColumn("share", F.expr(f"pmod(pmod(xxhash64('rff', string(key)), 1000000), {quality_model.SHARES})")).toPandas()
    x, y = rows[list(quality_model.STATS)].to_numpy(float), rows["quality"].to_numpy(float)
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scale, np.where(x.std(axis=0) == 0, 1, x.std(axis=0)))

    def ridge(keep):
        f = quality_model.fourier(m, x[keep])
        return np.linalg.solve(f.T @ f + quality_model.RIDGE * np.eye(f.shape[1]), f.T @ y[keep])

    assert np.allclose(m.weights, ridge(np.ones(len(x), bool)), atol=1e-6)
    share = rows["share"].to_numpy()
    raw = np.array([quality_model.fourier(m, x[i:i + 1]) @ ridge(share != share[i]) for i in range(len(x))]).ravel()
    # The steps are the isotonic fit of these scores: bounds among them, values that rise.
    assert np.abs(raw[:, None] - m.steps[0]).min(axis=0).max() < 1e-6 and (np.diff(m.steps[1]) >= 0).all()
    order = np.argsort(raw)
    assert np.interp(raw[order], *m.steps).mean() == pytest.approx(y.mean(), abs=0.05)


# --- secrets -----------------------------------------------------------------

SECRETS = {
    "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-1234567890-abc", "google": "AIza" + "x" * 35,
    "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "private_key": "-----BEGIN PRIVATE KEY-----\nQUJD\n-----END PRIVATE KEY-----"}


@pytest.mark.parametrize("kind", sorted(SECRETS))
def test_every_added_kind(kind):
    text = f"before {SECRETS[kind]} after"
    spans = [(s, e) for k, s, e in secret_scan.find(text) if k == kind]
    assert spans == [(7, 7 + len(SECRETS[kind]))]


def test_a_kept_ledger_is_gone_on_with(spark, monkeypatch):
    docs = table(spark, SF_SMALL, "documents")
    spark.conf.set(secret_scan.LEDGER_CONF, scratch_path(spark, "kept-ledger"))
    todo, plain = [], secret_scan.unseen

    def watched(*args):
        out = plain(*args)
        todo.append(out.count())
        return out

    monkeypatch.setattr(secret_scan, "unseen", watched)
    try:
        first = sorted(secret_scan.query(spark, docs).collect())
        assert sorted(secret_scan.query(spark, docs).collect()) == first
        more = docs.unionByName(docs.limit(1).selectExpr("doc_id", "concat(text, ' new') AS text", "lang", "source", "n_chars"))
        assert len(secret_scan.query(spark, more).collect()) == len(first) + 1
        assert todo == [docs.select("text").distinct().count(), 0, 1]
        # Two scans at the same time may both enter a blob; it is one entry when read.
        path = secret_scan.session_ledger(spark)
        spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
        spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
        assert secret_scan.read_ledger(spark, path + "-twice").count() == todo[0] + 1
    finally:
        spark.conf.unset(secret_scan.LEDGER_CONF)
    assert secret_scan.session_ledger(spark) != secret_scan.session_ledger(spark)


def test_rows_that_repeat_id_and_text_are_scanned_once():
    import pandas as pd

    rows = pd.DataFrame({"blob": [b"a", b"b", b"a"], "text": ["x", "token=abcdefghijklmn", "x"]})
    got = pd.concat(secret_scan._scan(iter([rows, rows])))
    assert got["blob"].tolist() == [b"a", b"b"] and [len(s) for s in got["spans"]] == [0, 1]


# --- near duplicates -----------------------------------------------------------

def test_every_pair_of_the_threshold_is_linked(spark):
    """All pairs of 0.8 or more, found by brute force, share a class; no class joins what no chain of them joins."""
    rows = table(spark, SF_MID, "documents").select("doc_id", "text").collect()
    sets, holders = {}, collections.defaultdict(list)
    for r in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (r.text or "").lower()) if x]
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
        for s in sets[r.doc_id]:
            holders[s].append(r.doc_id)
    shared = collections.Counter(p for ids in holders.values() for p in itertools.combinations(ids, 2))
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.class_id for r in near_dedup.query(spark, table(spark, SF_MID, "documents")).collect()}
    assert len(pairs) > 50 and all(got[a] == got[b] for a, b in pairs)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {i: find(i) for i in sets}
