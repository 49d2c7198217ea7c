import math
import re
import zlib
from collections import Counter

import pytest
from helpers import documents, sentence, spaced

from dueday.llm.lattice_lm import RANK_OFFSET, STOP, piece_logs, score
from dueday.llm.sentencepieces import StreamingViterbi, decode, encode
from dueday.llm.vocabulary import MODEL, load_vocabulary

TEXTS = ["", " ", "the of", "  two  spaces ", "Ascirr para osóciónta\ncióngañ.\t no", "日本語 🙂 x▁y", "a\x00b", "x" * 300, "ab " * 200, "thntering, reingwhnd"]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary()


def best_sum(v, data):
    known = {v.pieces[i]: float(v.scores[i]) for i in v.normal}
    best = [0.0]
    for e in range(1, len(data) + 1):
        ways = [best[b] + known[data[b:e]] for b in range(max(0, e - v.lengths[0]), e) if data[b:e] in known]
        best.append(max([*ways, best[-1] + v.fallback]))
    return best[-1]


def total(v, ids):
    usual = set(v.normal.tolist())
    return sum(float(v.scores[i]) if i in usual else v.fallback for i in ids)


def test_round_trip_and_best_sums(spark, vocabulary):
    docs = documents(spark, [*enumerate(TEXTS), (99, None), (7, TEXTS[7])])
    rows = decode(encode(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.decoded == r.text
        if r.text is None:
            assert r.ids is None
        else:
            data = (" " + r.text if r.text else "").encode()
            assert total(vocabulary, r.ids) == pytest.approx(best_sum(vocabulary, data))
    assert decode(encode(documents(spark, []))).collect() == []


def test_streaming_gives_the_same_ids_in_any_steps(spark, vocabulary):
    text = " " + " ".join(TEXTS) + sentence(30)
    (row,) = encode(documents(spark, [(1, text[1:])])).collect()
    for step in (1, 3, 17, 1000):
        stream, data, ids, held = StreamingViterbi(vocabulary), text.encode(), [], 0
        for k in range(0, len(data), step):
            ids += stream.feed(data[k : k + step])
            held = max(held, len(stream.data))
        assert [*ids, *stream.finish()] == row.ids
        assert step > 100 or held < 8 * vocabulary.lengths[0]


def test_decoding_odd_ids(spark):
    rows = spark.createDataFrame([(1, [0, 1, 2, None, 10**6]), (2, []), (3, None), (4, [3 + 0xC3])], "k int, ids array<int>")
    assert [r.decoded for r in decode(rows).orderBy("k").collect()] == ["", "", None, "�"]


def segmentations(v, logs, other, word):
    """Probability of a word by walking over all its segmentations."""
    known = {v.pieces[i]: math.exp(logs[i]) for i in v.normal}

    def walk(at):
        if at == len(word):
            return 1.0
        out = math.exp(other) * (1 - STOP) * walk(at + 1)
        for e in range(at + 1, len(word) + 1):
            if word[at:e] in known:
                out += known[word[at:e]] * (1 - STOP) * walk(e)
        return out

    return walk(0) / (1 - STOP) * STOP


def test_scores_equal_brute_force(spark, vocabulary):
    rows = [(k, f"the dog Of {'x' * (k % 3)} ran {k % 5} thé") for k in range(40)] + [(50, None), (51, ""), (52, "new words " + "q" * 30), (50, "dog")]
    train = Counter()
    ends = 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(spaced(t))
            ends += 1
    n, kinds = sum(train.values()) + ends, len(train) + 1
    logs, other = piece_logs(vocabulary)
    cache = {}

    def word_log(w):
        if w not in cache:
            data = (" " + w).encode()
            lattice = segmentations(vocabulary, logs, other, data) if len(data) < 14 else None
            cache[w] = lattice
        return cache[w]

    found = score(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(spaced(t))
    for r in found:
        own = min(texts[r.doc_id], key=lambda w: abs(len(w) + 1 - r.n_tokens))
        assert r.n_tokens == len(own) + 1 and r.train_tokens == n
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.n_known == sum(train[w] > 0 for w in own) + 1
        base = sum(math.log10((train[w] + 1) / (n + kinds + 1)) for w in own) + math.log10((ends + 1) / (n + kinds + 1))
        assert r.base_score == pytest.approx(base)
        if all(word_log(w) is not None for w in own):
            model = sum(math.log10((train[w] + kinds * word_log(w)) / (n + kinds)) for w in own) + math.log10((ends + 1) / (n + kinds + 1))
            assert r.score == pytest.approx(model, rel=1e-5)
        else:
            assert math.isfinite(r.score)


def test_scores_of_odd_tables(spark):
    assert score(documents(spark, [])).collect() == []
    rows = score(documents(spark, [(None, "a b"), (None, "a b")]), held_out="true").collect()
    assert [(r.doc_id, r.held_out, r.n_known, r.train_tokens) for r in rows] == [(None, True, 0, 0)] * 2
    assert all(math.isfinite(r.score) for r in rows)


def test_piece_probabilities_sum_to_one(vocabulary):
    logs, other = piece_logs(vocabulary)
    assert sum(math.exp(x) for x in logs[vocabulary.normal]) + 256 * math.exp(other) == pytest.approx(1.0)
    assert RANK_OFFSET > 0 and re.search("model$", MODEL)
