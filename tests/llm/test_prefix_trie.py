"""Conversation prefix trie against a plain Python version."""

import collections
import hashlib
import math
import zlib

import pytest

from panelcast.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, c int, d int, node int, saved int, band int"


def brute(rows):
    own = collections.defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            role, text = r.role or "", r.text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[r.conv_id].append((-1 if r.turn is None else r.turn, tie, (role, text)))
    own = {c: [t[2] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()), key=repr)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def result(df, **kw):
    return sorted((tuple(r[n] for n in NAMES) for r in prefix_trie.trie(df, **kw).collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """One long conversation, copies, borrowed starts that are short or absent, null and repeated turns, ties."""
    rows = [(200, i, "user" if i % 2 else "assistant", f"turn {i % 3}") for i in range(150)]
    rows += [(c, i, "user" if i % 2 else "assistant", f"turn {i % 3}") for c in range(201, 260) for i in range(c % 9)]
    rows += [(c, i, "user", "same") for c in range(300, 340) for i in range(7)]
    rows += [(c, i, None, "short start") for c in (400, 401, 402, 403, 404, 405) for i in range(2 if c == 400 else 8)]
    rows += [(c, i, "user", "no start é😀") for c in range(501, 520) for i in range(6)]
    rows += [(c, 0, "system", "one turn") for c in range(601, 640)]
    rows += [(-5, 1, "user", "below"), (-5, 0, "user", "zero"), (0, 3, "user", "zero"), (7, None, "user", None), (7, None, None, "x"),
             (7, 0, "", ""), (7, 0, "", ""), (7, 0, "a", ""), (7, 0, "", "a"), (None, 0, "user", "lost"), (None, None, None, None),
             (8, 2, "user", "long " * 20_000), (9, 2, "user", "long " * 20_000)]
    return spark.createDataFrame([(*r, *[i] * 5) for i, r in enumerate(rows)], SCHEMA)


def test_matches_brute_force(odd, monkeypatch):
    want = brute(odd.collect())
    assert max(w[1] for w in want) >= 150 and any(w[3] > 20 and w[1] > 3 for w in want)
    assert result(odd) == want
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)  # ids are streamed in many texts
    monkeypatch.setattr("panelcast.llm.common.HEAVY", 2)
    assert result(odd, band=2) == want  # eight levels of bands


def test_empty_tables(spark, odd):
    assert result(odd.limit(0)) == []
    assert result(odd.where("conv_id is null")) == []
    alone = result(odd.where("conv_id = 0"))
    assert [r[:7] for r in alone] in ([(0, 0, None, 1, 0, 1, 0)], [(0, 0, None, 1, 1, 1, 0), (0, 1, 0, 1, 0, 1, 0)])
    with pytest.raises(ValueError):
        result(odd, band=1)
