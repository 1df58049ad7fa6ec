"""Fingerprints, BPE, personal data: against brute force on awkward rows and a small table."""

import hashlib
import re

import numpy as np
import pytest
from llm_fixtures import AWKWARD, documents, shared_folder  # noqa: F401

from shopcast.llm import bpe, minhash, pii, tables, text

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return df.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa
    h, starts, ends, first = text.word_hashes(*text.string_bytes(pa.array(["b a", None, "", "a  b\n", "a"])))
    assert first.tolist() == [0, 2, 2, 2, 4, 5] and h[0] == h[3] and h[1] == h[2] == h[4] and h[0] != h[1]


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def test_fingerprints(spark):
    docs = tables.table(spark, SF, "documents")
    got = rows_of(minhash.edited_pairs(docs, 7))
    raw = rows_of(docs)
    errors = []
    for i, t in enumerate(raw.text):
        after = raw.text[(i + 1) % len(raw)]
        edited = minhash.edit(t, after)
        assert got.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and got.n_chars[i] == len(t)
        a, b, e = shingles(t), shingles(after), shingles(edited)
        errors += [got.near_edited[i] - len(a & e) / len(a | e), got.near_next[i] - len(a & b) / len(a | b)]
    assert np.abs(errors).mean() < 0.03 and abs(np.mean(errors)) < 0.01
    alone = rows_of(minhash.fingerprints(docs))
    assert (alone.fingerprint == got.fingerprint).all()
    assert (got.groupby(raw.text).fingerprint.nunique() == 1).all()


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_pack_round_trip(bits):
    v = np.random.default_rng(bits).integers(0, 1 << bits, (5, 64), dtype=np.uint8)
    assert (minhash.unpack(minhash.pack(v, bits), bits) == v).all()


def test_fingerprints_of_awkward_rows(spark):
    got = minhash.edited_pairs(documents(spark, extra=True), 3).toPandas()
    assert len(got) == len(AWKWARD)
    one = got.set_index("doc_id")
    assert one.loc[0].fingerprint == one.loc[5].fingerprint and one.loc[2].fingerprint == one.loc[3].fingerprint == ""
    assert one.loc[1].n_chars == 0 and one.loc[1].near_next == 1.0     # null, then empty
    empty = documents(spark, [])
    assert minhash.edited_pairs(empty, 3).count() == 0
    single = minhash.edited_pairs(documents(spark, [(5, "a b c d e f")]), 3).toPandas()
    assert single.near_next.tolist() == [1.0]


def test_bpe_equals_the_rank_merges(spark):
    import public_tokenizers
    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["\x1c\x1d a", "a　 b", "\U0003D972x\U0003EE5C", "<|endoftext|>", "it's 'LL", "﻿​", "a" * 3000]
    for docs, rows in ((documents(spark, extra=True), AWKWARD), (documents(spark, list(enumerate(odd))), list(enumerate(odd))),
                       (tables.table(spark, SF, "documents"), None)):
        rows = rows or [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = bpe.encoded(docs, path, public_tokenizers.PATTERN, keep_ids=True).collect()
        want = sorted((str(i), enc.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in got) == want
        assert all(r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in got)
    assert bpe.encoded(documents(spark, []), path, public_tokenizers.PATTERN).count() == 0


def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    import random
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("ab.@-+ 0123456789()\n%é") for _ in range(rng.randint(0, 90)))
        assert pii.base_spans(t) == brute_base(t)


def test_field_learns_its_table_and_finds_more():
    field = pii.train(pii.labelled_table())
    table = pii.labelled_table()
    found = pii.added_spans([t for t, _ in table], [[] for _ in table], field)
    assert sum(sorted(a) == sorted(s) for a, (_, s) in zip(found, table, strict=True)) > 0.97 * len(table)
    new = ["please ring (212) 555-0199 soon", "mail root@localhost today", "in 1999 there were 12 of 40"]
    spans = pii.added_spans(new, [[], [], []], field)
    assert [[(pii.KINDS[k], t[s:e]) for s, k, e in x] for t, x in zip(new, spans, strict=True)] == [
        [("phone", "(212) 555-0199")], [("email", "root@localhost")], []]


def test_numbers_that_fail_their_check_are_left_alone():
    """Decoys: a lone number, groups, a number beside another, with signs around them."""
    field = pii.train(pii.labelled_table())
    right, wrong = "4111111111111111", "4111111111111112"
    texts = [f"in {wrong} words", f"{wrong}.", f"the {wrong}*** of", f"a {wrong} {wrong} b", "row 4111 1111 1111 1112 of", "so 4111-1111-1111-1112, no",
             f"a {right} {right} b", f"a {wrong} {right} b", "host 300.1.2.3 is", "build 10.999.2.3 of"]
    spans = pii.added_spans(texts, [[] for _ in texts], field)
    got = [[(pii.KINDS[k], t[s:e]) for s, k, e in x] for t, x in zip(texts, spans, strict=True)]
    assert got == [[]] * 6 + [[("card", right)] * 2, [("card", right)], [], []]
    chain = pii.chains_of("4111 1111 1111 1111")[0]
    assert [s for *_, s in chain] == ["d4" + pii.RIGHT] * 4


def test_field_on_patterns_it_has_not_seen():
    """Every fifth line held out, with all its draws."""
    hit = extra = missed = 0
    for k in (0, 2):
        field = pii.train(pii.labelled_table(tuple(x for i, x in enumerate(pii.LABELLED) if i % 5 != k)))
        rows = pii.labelled_table(tuple(x for i, x in enumerate(pii.LABELLED) if i % 5 == k))
        for (_, want), got in zip(rows, pii.added_spans([t for t, _ in rows], [[] for _ in rows], field), strict=True):
            hit, extra, missed = hit + len({*want} & {*got}), extra + len({*got} - {*want}), missed + len({*want} - {*got})
    assert hit / (hit + extra) > 0.8 and hit / (hit + missed) > 0.6


def test_long_words_are_read_whole():
    assert pii.shape_of("x" * 300 + "@y.org") == "a@a.a"
    word = "é" * 300 + "7" + "-" * 5000
    assert pii.token_at("a " + word, 2, 2 + len(word)) == (302, 303, "d1")
    assert pii.token_at("y" * 9000 + "...", 0, 9003) == (0, 9000, "a")
    field = pii.train(pii.labelled_table())
    texts = [f"mail {'root' * n}@localhost{end} today" for n in (1, 100, 2000) for end in ("", ".")]
    spans = pii.added_spans(texts, [[] for _ in texts], field)
    assert [[(pii.KINDS[k], t[s:e]) for s, k, e in x] for t, x in zip(texts, spans, strict=True)] == [
        [("email", t.split()[1].rstrip("."))] for t in texts]
    assert len(pii.added_spans(["a1" * 500_000 + "-" * 500_000], [[]], field)) == 1


def test_viterbi_is_the_best_path():
    from itertools import product
    field = pii.train(pii.labelled_table(), rounds=20)
    for chain in (["d3-d4"], ["+d1", "(d3)", "d3-d4"], ["d4", "d4", "d4"]):
        e = field.emissions(chain)
        score = lambda p: field.start[p[0]] + sum(e[t, x] for t, x in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(product(range(len(pii.LABELS)), repeat=len(chain)), key=score)
        assert score(tuple(field.viterbi([chain])[0].tolist())) == pytest.approx(score(best))


def test_personal_data_of_awkward_rows(spark):
    got = rows_of(pii.found(documents(spark, extra=True)))
    assert len(got) == len(AWKWARD)
    for r in got.itertuples():
        t = next((t for i, t in AWKWARD if i == r.doc_id or i is None and r.doc_id != r.doc_id), None) or ""
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(t))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
    docs = documents(spark, extra=True)
    masked = pii.masked(docs)
    assert masked.schema == docs.schema
    rows = {r.doc_id: r for r in masked.collect()}
    assert rows[6].text == "mail [EMAIL] or [IP] now" and rows[6].n_chars == len(rows[6].text)
    assert rows[10].text == "call [PHONE] or pay [CARD] today" and rows[1].text is None and rows[0].text == AWKWARD[0][1]
    assert pii.found(documents(spark, [])).count() == 0
