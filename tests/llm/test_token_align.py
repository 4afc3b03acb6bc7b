"""Cross-tokenizer alignment against a plain byte-by-byte version."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF_SMALL
from panelcast.llm import token_align
from panelcast.llm.common import table

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def bytes_of_a(tok, i):
    return bytes(LETTERS[c] for c in tok.id_to_token(i))


def letters():
    """Byte of each character of the byte-level alphabet, from the alphabet's rule."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


def brute(texts):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] of the texts of all documents."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    held, docs = [], collections.Counter()
    for text in texts:
        ids_a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b_tok.encode(text or "")
        parts_a = [bytes_of_a(a_tok, i) for i in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, b_tok.id_to_piece(i)) for i in ids_b)]
        target = (" " + (text or "")).encode()
        if not text or b"".join(parts_a) != target or b"".join(parts_b) != target:
            held.append(None)
            continue
        own_a = [k for k, p in enumerate(parts_a) for _ in p]  # token of each byte
        own_b = [k for k, p in enumerate(parts_b) for _ in p]
        links = sorted(set(zip(own_a, own_b)))
        groups, now = [], ([], [])
        for at in range(len(target)):
            last_a = at + 1 == len(target) or own_a[at + 1] != own_a[at]
            last_b = at + 1 == len(target) or own_b[at + 1] != own_b[at]
            if last_a:
                now[0].append(str(ids_a[own_a[at]]))
            if last_b:
                now[1].append(str(ids_b[own_b[at]]))
            if last_a and last_b:
                groups.append(",".join(now[0]) + "|" + ",".join(now[1]))
                now = ([], [])
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        docs.update(set(pairs))
        held.append((len(ids_a), len(ids_b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return [(0,) * 6 + ("",) if h is None else
            (*h[:3], len(h[3]), sum(docs[p] == best[p[0]] for p in h[3]), sum(docs[p] for p in h[3]), h[4]) for h in held]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(docs):
    got = token_align.query(docs.sparkSession, docs).collect()
    return sorted(((r.doc_id, *[r[n] for n in NAMES]) for r in got), key=repr)


def test_whole_table(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]))]
    assert result(docs) == sorted(want, key=repr)


@pytest.fixture()
def odd(spark):
    """Nulls, empty and long texts, copies, repeated ids, special tokens, normalized and non-Latin text."""
    texts = [None, "", " ", "a", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ marks", "two  spaces \n\n\ttabs \x00 nul",
             "日本語のテキスト", "é ½ ﬁ Å Å", "emoji 😀👩‍👩‍👧 end", "word " * 3000, "x" * 30_000, "same text", "same text", "same text",
             "same texts"]
    rows = [(None if i % 5 == 4 else i // 2, t, i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, pair int")


def test_odd_texts_with_and_without_common_pairs(spark, odd, monkeypatch):
    rows = odd.collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]))), key=repr)
    assert sum(w[1] == 0 for w in want) >= 3 and any(w[1] > 3000 for w in want)
    assert result(odd) == want
    monkeypatch.setattr(token_align, "COMMON", 0)  # every pair goes by the shuffle
    monkeypatch.setattr(token_align, "HELD", 50)  # tasks emit their sums many times
    monkeypatch.setattr("panelcast.llm.common.HEAVY", 2)
    assert result(odd) == want


def test_empty_table(spark, odd):
    assert token_align.query(spark, odd.limit(0)).collect() == []
