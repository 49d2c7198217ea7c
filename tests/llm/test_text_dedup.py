import random

from helpers import documents, jaccard_groups, repeats_removed, sentence

from dueday.llm import jaccard
from dueday.llm.jaccard import keep_one, near_duplicates
from dueday.llm.links import components
from dueday.llm.suffixes import common_prefix_breaks, cut_repeats, remove_repeats, repeated_windows, suffix_order

import numpy as np


def varied(words, k, rng):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def near_copies():
    rng, rows = random.Random(3), []
    for family in range(6):
        base = sentence(60 + 40 * family, family).split()
        rows += [(100 * family + k, varied(base, rng.choice([0, 0, 1, 1, 2, 3, 6]), rng)) for k in range(14)]
    passage = sentence(50, 77)
    rows += [(1000 + k, f"{passage} {sentence(80 + k, 200 + k)}") for k in range(12)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"),
             (2006, sentence(5000, 9)), (2007, sentence(5000, 9) + " tail"), (2008, "a b c d e"), (2009, "a b c d e a b c d e")]
    return rows


def test_jaccard_equals_brute_force(spark):
    rows = near_copies()
    found = near_duplicates(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == jaccard_groups(rows)


def test_jaccard_odd_rows(spark):
    docs = documents(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, "A b c d e f"), (9, None)])
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 2, None), (5, 2, 4), (5, 2, 4), (4, 2, 4), (9, 0, 9)], key=str)
    kept = keep_one(docs)
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "a b c d e f"), (4, "A b c d e f"), (9, None)], key=str)
    assert near_duplicates(documents(spark, [])).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 10), *[(100 + k, 101 + k) for k in range(40)]]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, **{100 + k: 100 for k in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_backward_extension_gives_common_prefixes():
    rng = np.random.default_rng(5)
    for n in (2, 3, 40, 700):
        symbols = rng.integers(0, 3, n).astype(np.int16)
        symbols[-1] = 0
        order, _ = suffix_order(symbols, 12)
        turned = [tuple(np.roll(symbols, -p)[:9].tolist()) for p in order]
        assert turned == sorted(turned)
        breaks = common_prefix_breaks(symbols[order - 1], 9)
        assert breaks[1:].tolist() == [a != b for a, b in zip(turned, turned[1:])]


def test_repeated_windows_of_contexts():
    texts = [b"abcdefgh", b"xbcdefgz", b"q"]
    group, owner, offset = repeated_windows([np.frombuffer(t, np.uint8) for t in texts], 5)
    found = {}
    for g, o, f in zip(group, owner, offset):
        found.setdefault(g, set()).add((int(o), texts[o][f : f + 5]))
    assert sorted(map(sorted, found.values())) == [[(0, b"bcdef"), (1, b"bcdef")], [(0, b"cdefg"), (1, b"cdefg")]]


def repeats():
    rng = random.Random(1)
    shared = [sentence(40, s) for s in range(3)]
    rows = [(k, f"{sentence(rng.randrange(1, 60), 50 + k)} {rng.choice(shared)}é {sentence(9, 90 + k)}") for k in range(25)]
    rows += [(30, shared[0]), (31, shared[0]), (32, shared[0][:99]), (33, "ab" * 300), (34, "é" * 200), (35, None), (36, ""),
             (37, "x" + "é" * 120), (-4, shared[1] * 2), (38, sentence(30000, 5)), (39, sentence(30000, 5)[7:])]
    return rows


def test_repeats_equal_brute_force(spark):
    rows = repeats()
    found = remove_repeats(documents(spark, rows)).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == repeats_removed(rows)
    texts = {r.doc_id: r.kept_text for r in found}
    assert texts[35] is None and texts[36] == "" and texts[31] == "" and texts[-4] != ""


def test_repeats_odd_rows(spark):
    text = sentence(40, 1)
    docs = documents(spark, [(7, text), (7, text), (7, text + " more"), (None, text), (3, "short")])
    found = remove_repeats(docs).collect()
    assert [r.n_removed for r in found if r.doc_id is None] == [len(text)]
    both = [r.n_removed for r in found if r.doc_id == 7 and r.n_bytes == len(text)]
    assert len(both) == 2 and both[0] == both[1]
    kept = cut_repeats(docs)
    assert kept.columns == docs.columns
    assert all(r.text for r in kept.collect())
    assert remove_repeats(documents(spark, [])).collect() == []


def test_rows_given_twice_are_no_copies_of_themselves(spark):
    text, other = sentence(40, 1), sentence(40, 2)
    rows = [(7, text), (None, other), (3, "short"), (7, text), (None, other), (7, text)]
    for docs in (documents(spark, rows).coalesce(1), documents(spark, rows).repartition(6)):
        assert [r.n_removed for r in remove_repeats(docs).collect()] == [0] * 6
        assert sorted(((r.doc_id, r.text) for r in cut_repeats(docs).collect()), key=str) == sorted(rows, key=str)


def test_cut_repeats_leaves_other_rows_alone(spark):
    rows = repeats()
    docs = documents(spark, rows)
    kept = {r.doc_id: r for r in cut_repeats(docs).collect()}
    removed = {d: n for d, _, n, _, _ in repeats_removed(rows)}
    plain = dict(rows)
    for d, n in removed.items():
        if not n:
            assert kept[d].text == plain[d]
        elif d in kept:
            assert kept[d].n_chars == len(kept[d].text) and len(kept[d].text.encode()) <= len(plain[d].encode()) - n
    assert 31 not in kept


def test_rows_of_one_id_or_none_are_spread():
    """A third of the rows without an id and a third under one id: no part holds much more than its share."""
    import numpy as np

    from dueday.llm.packs import row_part

    n = 30_000
    ids = np.where(np.arange(n) % 3 == 0, np.iinfo(np.int64).max, np.where(np.arange(n) % 3 == 1, 7, np.arange(n))).astype(np.int64)
    tags = np.random.default_rng(1).integers(0, 1 << 32, n)
    sizes = np.bincount(row_part(ids, tags, 64), minlength=64)
    assert sizes.max() < 1.3 * n / 64 and sizes.min() > 0.7 * n / 64
    assert np.bincount(row_part(np.arange(n), np.zeros(n, np.int64), 64), minlength=64).max() < 1.3 * n / 64


def test_pipeline_keeps_columns_with_the_operators_names(spark, sf_dir):
    import corpus_pipeline

    text = "one passage of some length that stands in both of these documents, word for word, and is cut out of the second one"
    rows = [(1, text, "a", "b", "c", "d"), (2, f"start {text} end", "a", "b", "c", "d"), (2, f"other {text} end", "a", "b", "c", "d"), (None, "x", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut_tag string, cut_text string, cut_id string, benchmark string")
    cut = corpus_pipeline.suffix_array_dedup(spark, docs, sf_dir)
    assert cut.columns == docs.columns and {r.cut_text for r in cut.collect()} == {"b", None} and cut.count() == 4
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir)
    assert kept.schema == docs.schema and kept.count() == 4 and {r.benchmark for r in kept.collect()} == {"d", None}


def test_bit_tables_of_few_texts_are_small(spark, monkeypatch):
    made = []
    bits = jaccard._rarity_bits
    monkeypatch.setattr(jaccard, "_rarity_bits", lambda *a: made.append(bits(*a)) or made[-1])
    same = "one text of seven words that repeats "
    rows = [(k, same * 3 if k % 2 else f"{k} other words here and there " * 5) for k in range(40)]
    found = near_duplicates(documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {k: 1 if k % 2 else k for k in range(40)}
    assert made[0].any() and made[0].nbytes <= 1 << 18


def test_blocks_hold_what_may_link_and_postings_one_of_equal_texts(spark, monkeypatch):
    """Texts that share a passage but can reach no other, and copies, do not travel."""
    word = lambda k, i: f"w{k}x{i}"
    passage = [word("p", i) for i in range(12)]
    rows = [(k, " ".join([*passage, *(word(k, i) for i in range(100))])) for k in range(6)]
    near = [word("n", i) for i in range(112)]
    rows += [(10, " ".join(near)), (11, " ".join([*near[:-1], "other"])), *((100 + k, " ".join(near)) for k in range(20))]
    written, write, asked, postings = {}, jaccard.materialize, [], jaccard._postings
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    monkeypatch.setattr(jaccard, "_postings", lambda docs, *a: asked.append(docs) or postings(docs, *a))
    found = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows)).collect()}
    assert found == {k: k if k < 10 else 10 for k, _ in rows}
    block = written["blocks"].collect()
    assert sum(len(r.nodes) // 8 for r in block) == 2 and sum(len(r.tokens) // 8 for r in block) < 2 * 108
    assert asked[0].count() == 8
