"""Packing: ids against the library, cuts against exhaustive search, pieces against a round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import documents, shared_folder  # noqa: F401

from shopcast.llm import packing as K

SPEC = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(SPEC, encoding="utf-8") as f:
        return K.Encoder(f.read())


def library(encoder, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in encoder.model.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_librarys(encoder):
    rng = random.Random(1)
    atoms = ["the", "Word", "é", "漢字", "don't", "x.y", "3", "12,5", "\U0001F600", "<|endoftext|>", "'s", "́", "ß", "﻿", "-"]
    gaps = [" ", "  ", "\n", " \n", "\n ", "\t", " ", " ", "\x1c", "\x85", "᠎", "​", "   ", ""]
    texts = ["", " ", "  ", " a", "a ", "a  b", "\n a b", "a\n b", "a \nb c", "x" * 5000, "word " * 3000, "  a  b"]
    texts += ["".join(rng.choice(atoms) + (" " if rng.random() < 0.6 else rng.choice(gaps)) for _ in range(rng.randint(1, 40)))
              for _ in range(400)]
    for _ in range(2):      # learnt, then remembered
        assert encoder.encode(texts) == library(encoder, texts)


def test_any_character_beside_a_space(encoder):
    texts = [f"a{c} b {c} {c}d" for c in map(chr, range(0x3100)) if not 0xD800 <= ord(c) < 0xE000]
    assert encoder.encode(texts) == library(encoder, texts)


def test_any_character_beside_a_mark(encoder):
    texts = [f"a{c}. {c}'s é{c}, .{c} ({c}" for c in map(chr, range(0x3100)) if not 0xD800 <= ord(c) < 0xE000]
    assert encoder.encode(texts) == library(encoder, texts)


def test_a_word_is_asked_for_once_whatever_follows_it(encoder, monkeypatch):
    asked, ids = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda keys: asked.extend(keys) or ids(keys))
    texts = ["a flurm### flurm flurm, flurm.\nThe flurm&&& (flurm)", "a flurm; flurm's"]
    assert encoder.encode(texts) == library(encoder, texts)
    assert sum(t.count(" flurm") for t in asked) == 1


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(K, "CACHE_BYTES", 500)
    for texts in (["one two three", "four  five six"], ["seven two", "four  five"], ["one two three"]):
        assert encoder.encode(texts) == library(encoder, texts)


def test_a_full_cache_keeps_what_is_in_use(encoder, monkeypatch):
    monkeypatch.setattr(K, "CACHE_BYTES", 10)
    texts, asked, ids = ["one two, three\nfour", "five two", ""], [], encoder._ids
    want = encoder.encode(texts)
    monkeypatch.setattr(encoder, "_ids", lambda keys: asked.extend(keys) or ids(keys))
    assert encoder.encode(texts) == want == library(encoder, texts) and not asked
    encoder.encode(["six"])
    assert "five" not in encoder.parts and set(encoder.heads) == {"six"}


def cost_of(cuts, places, penalties, window, shortest):
    at, total = 0, 0
    for c in cuts:
        n = c - at
        if not 0 < n <= window:
            return None
        total += (0 if n & (n - 1) == 0 and n >= shortest else window - n) + penalties.get(c, K.INSIDE) + K.EACH
        at = c
    return total


def exhaustive(places, penalties, window, shortest):
    """Least cost over all cuts at the places and where full windows end inside a sentence without a near end."""
    end, slack, todo = places[-1], K.INSIDE - K.SENTENCE, [0, *places]
    nodes = set(todo)
    while todo:
        at = todo.pop()
        if at + window < end and at + window not in nodes and not any(at + window - slack <= p <= at + window for p in places):
            nodes.add(at + window)
            todo.append(at + window)
    best = {0: 0}
    for p in sorted(nodes - {0}):
        best[p] = min(best[at] + cost_of([p - at], None, {p - at: penalties.get(p, K.INSIDE)}, window, shortest)
                      for at in best if p - window <= at)
    return best[end]


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    window, shortest = 64, 8
    n = rng.randint(1, 900)
    places = sorted(set(rng.sample(range(1, n + 1), rng.randint(0, min(n, n // rng.choice([3, 10, 60, 200]) + 1)))) | {n})
    penalties = {p: rng.choice([0, K.SENTENCE]) for p in places}
    penalties[n] = 0
    cuts = K.window_cuts(np.array(places), np.array([penalties[p] for p in places]), window, shortest=shortest)
    assert cuts[-1] == n
    assert cost_of(cuts, places, penalties, window, shortest) == exhaustive(tuple(places), penalties, window, shortest)


def check_pieces(df, rows, encoder, window=K.WINDOW):
    got = df.collect()
    want = sorted(np.frombuffer(x + K.CLOSING, "<u4").tolist() for x in library(encoder, [t or "" for _, t in rows]))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert 0 < sum(r.length for r in pieces) <= window and all(r.length > 0 for r in pieces)
    assert sum(r.length for r in got) == sum(map(len, want))
    by_id = {}
    for i, t in rows:
        ids = np.frombuffer(library(encoder, [t or ""])[0] + K.CLOSING, "<u4")
        by_id.setdefault(i, []).append(ids)
    covered = {}
    for r in got:
        same = [ids for ids in by_id[r.doc_id] if len(ids) == r.doc_tokens
                and zlib.crc32(ids[r.start:r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32]
        assert same
        covered.setdefault((r.doc_id, r.doc_tokens), []).extend(range(r.start, r.start + r.length))
    for i, copies in by_id.items():
        for size in {len(c) for c in copies}:
            assert sorted(covered[i, size]) == sorted(list(range(size)) * sum(len(c) == size for c in copies))
    lengths = [sum(r.length for r in p) for p in sequences.values()]
    return got, sum(0 if n & (n - 1) == 0 else window - n for n in lengths) / max(1, sum(lengths))


def test_pieces_of_awkward_rows(spark, encoder):
    from llm_fixtures import AWKWARD
    for extra in (False, True):
        df = K.packed(documents(spark, extra=extra), SPEC)
        assert df.columns == ["doc_id", *K.COLUMNS]
        check_pieces(df, AWKWARD, encoder)
    assert K.packed(documents(spark, []), SPEC).count() == 0


def test_a_document_beyond_a_block_and_a_slice(spark, encoder, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    text = lambda n, stop: " ".join(rng.choice(words) + ("." if rng.random() < stop else "") for _ in range(n))
    rows = [(0, text(300, 0.1)), (1, text(400_000, 0.05)), (2, text(60_000, 0.0)), (3, None), (4, text(2000, 0.1))]
    assert len(rows[1][1]) > 2 << 20
    got, padding = check_pieces(K.packed(documents(spark, rows).coalesce(1), SPEC), rows, encoder)
    assert padding < 0.02 and max(r.doc_tokens for r in got) > K.BLOCK


def test_little_padding_and_the_same_again(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got, padding = check_pieces(K.packed(docs, SPEC), rows, encoder)
    assert padding < 0.02
    assert sorted(got) == sorted(K.packed(docs, SPEC).collect())
    places = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))]
    order = {i: n for n, (i, _) in enumerate(rows)}
    assert places == sorted(places, key=order.__getitem__)      # the table's order is kept
