from helpers import contamination, documents, sentence

from dueday.llm.decontaminate import SuffixAutomaton, decontaminate


def inputs():
    items = [(1, sentence(30, 1)), (2, sentence(13, 2)), (3, "only five words are here"), (4, sentence(30, 1)), (5, None), (6, "..."),
             (None, sentence(20, 3)), (7, sentence(10, 1) + " " + sentence(20, 4)), (10, "solo")]
    rows = [
        (1, sentence(30, 1)), (2, f"intro {sentence(30, 1).upper()} outro"), (3, " ".join(sentence(30, 1).split()[:12])),
        (4, " ".join(sentence(30, 1).split()[4:18]) + " " + sentence(400, 9)), (5, "ONLY five, words are here!"), (6, None), (7, ""),
        (8, sentence(20, 3)), (9, sentence(3000, 11) + " " + sentence(13, 2) + " " + sentence(13, 2)), (10, "solo"), (11, "--- solo é"),
        (12, " ".join(sentence(30, 1).split()[:13] + sentence(30, 1).split()[5:25])),
    ]
    return rows, items


def check(spark, rows, items, **more):
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(documents(spark, rows), frame, **more).collect()
    got = [(r.doc_id, r.benchmark.n_words, r.benchmark.n_hit, list(r.benchmark.item_ids), r.benchmark.contaminated) for r in found]
    assert sorted(got) == sorted(contamination(rows, items))
    return {r.doc_id: r for r in found}


def test_equals_brute_force(spark):
    rows, items = inputs()
    found = check(spark, rows, items)
    assert found[2].benchmark.clean_text == "intro  outro" and found[3].benchmark.clean_text == found[3].text
    assert found[6].benchmark.clean_text is None and found[1].lang == "en"


def test_rounds_give_the_same(spark):
    rows, items = inputs()
    check(spark, rows, items, round_words=25)


def test_empty_tables(spark):
    rows, items = inputs()
    check(spark, rows, [])
    check(spark, [], items)


def test_longest_matches():
    automaton = SuffixAutomaton([("a", [1, 2, 3, 1, 2, 4]), ("b", [2, 3, 5])], 13)
    text = [9, 1, 2, 3, 5, 1, 2, 4, 2, 3, 1]
    found = [matched for _, _, matched in automaton.stream(text)]
    parts = [[1, 2, 3, 1, 2, 4], [2, 3, 5]]
    subs = {tuple(p[i:j]) for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    want = [max([k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in subs]) for i in range(len(text))]
    assert found == want
