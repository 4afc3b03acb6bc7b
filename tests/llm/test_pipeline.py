"""The pipeline: stages keep the columns, their decisions take effect, and the end matches the stages."""

import collections
import re

import corpus_pipeline
import pytest

from conftest import SF_SMALL
from panelcast.llm import mixing, near_dedup, quality_rules
from panelcast.llm.common import table
from panelcast.session import materialize


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF_SMALL, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF_SMALL), f"test-{name}"))
    return docs


def test_stages(spark, steps):
    first, ruled, single, clean, mixed, packed = steps
    names = first.columns
    assert all(s.columns == names for s in (ruled, single, clean, mixed))
    kept = {r.doc_id for r in quality_rules.query(first).where("kept").collect()}
    assert {r.doc_id for r in ruled.collect()} == kept
    stays = {r.doc_id for r in near_dedup.query(spark, ruled).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == stays and single.count() == len(stays)
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r.text for r in clean.collect()}
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]]
    assert changed and all("[SECRET]" in after[i] for i in changed)
    assert not any(re.search("[0-9a-f]{16}", t) for t in after.values())
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.query(spark, clean).collect()}
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == collections.Counter({i: t for i, (_, t) in taken.items() if t})
    assert packed.where("start = 0").count() == mixed.count()
    full = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in full) <= 2048


def test_run_gives_the_last_stage(spark, steps):
    want = collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in steps[-1].collect())
    got = collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF_SMALL).collect())
    assert got == want
