import gzip
import random
import textwrap
import time

import corpus_pipeline
import numpy as np
import pytest
from helpers import documents, groups

from dueday.llm import embedding_dedup, langid
from dueday.llm.chat import escaped, messages, read_back, render, turns_as_events, unescaped
from dueday.llm.langid import identify, keep_known
from dueday.llm.licenses import TEMPLATES, scan_documents
from dueday.llm.warc import EMPTY_MEMBER, gzip_member, read_archives, record, salvage, write_archives
from pyspark.sql import functions as F

SPOKEN = {"en": "the of and that with from there which", "de": "der die und nicht ist ein für über schön", "fr": "le la les et dans pour être été où"}


def spoken(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(SPOKEN[lang].split()) for _ in range(n))


def test_language_evidence(spark):
    rows = [(k, spoken(lang, 30, k), lang, f"https://{lang}{k % 3}.example.{lang}/p/{k}") for k, lang in enumerate(list(SPOKEN) * 40)]
    rows += [(500, spoken("de", 30, 5), "en", "https://de1.example.de/"), (501, "123 $$", "fr", None), (502, None, None, None), (503, "", "de", "x"),
             (504, "x1 zq", None, "https://fr0.example.fr/"), (None, spoken("fr", 20, 1), None, None), (1, rows[1][1], "de", rows[1][3])]
    docs = documents(spark, rows)
    found = identify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].language == lang for k, lang in enumerate(list(SPOKEN) * 40))
    assert by_id[500].language == "de" and by_id[504].language == "fr" and by_id[None].language == "fr"
    assert by_id[502].text_language is None and not by_id[502].known
    assert all(0 < r.probability <= 1 + 1e-9 for r in found)
    kept = keep_known(docs)
    assert kept.columns == docs.columns
    gone = {r[0] for r in rows} - {r.doc_id for r in kept.collect()}
    assert gone == {501, 502, 503}


def test_unsure_texts_with_letters_go(spark):
    rng = random.Random(7)
    rows = [(k, spoken(lang, 30 + k, k), lang, f"https://{lang}{k % 3}.example.{lang}/p/{k}") for k, lang in enumerate(list(SPOKEN) * 40)]
    noise = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(80))
    odd = [(500, spoken("en", 100, 1) + " " + spoken("de", 100, 2) + " " + spoken("fr", 100, 3), None, None), (501, noise, None, None),
           (502, "$$ 12 %% " * 30 + "there", "en", None), (503, "qqq", None, None), (504, noise, None, "https://en1.example.en/")]
    docs = documents(spark, rows + odd)
    assert {r.doc_id for r in keep_known(docs).collect()} == {r[0] for r in rows}
    only = corpus_pipeline.language_id(spark, docs, "", accepted=("de",)).collect()
    assert {r.doc_id for r in only} == {k for k, _, lang, _ in rows if lang == "de"}


def test_rare_languages_are_languages(spark, monkeypatch):
    rows = [(k, spoken("en", 12, k), "en", None) for k in range(3000)]
    rows += [(5000 + k, spoken("de", 30, k), "de", None) for k in range(3)] + [(6000 + k, spoken("fr", 30, k), "fr", None) for k in range(2)]
    right = lambda found: all(r.language == want for r in found for k, want in ((5, "de"), (6, "fr")) if r.doc_id // 1000 == k)
    assert right(identify(documents(spark, rows), fit_rows=20).where("doc_id >= 5000").collect())
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    found = identify(documents(spark, rows), fit_rows=20).collect()
    assert all(r.language == ("en" if r.doc_id < 5000 else langid.REST) for r in found)


def test_languages_without_labels_or_rows(spark):
    rows = identify(documents(spark, [(1, "some text", None, None)])).collect()
    assert [(r.language, r.known) for r in rows] == [(None, False)]
    assert identify(documents(spark, [])).collect() == []


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8))
    rows = [(k, (centers[k % 12] + rng.normal(scale=rng.choice([0.0, 0.1, 0.25]), size=8)).tolist()) for k in range(400)]
    rows += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [float("inf")] + [1.0] * 7), (904, []), (905, [1.0, None] + [1.0] * 6),
             (906, (centers[0] * 1e200).tolist()), (907, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    good = {k: np.array(v) / np.abs(v).max() for k, v in rows if k < 900 or k in (906, 907)}
    good = {k: v / np.linalg.norm(v) for k, v in good.items()}
    linked = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    found = groups([k for k, _ in rows], linked)
    degree = {k: sum(k in pair for pair in linked) for k, _ in rows}
    for cell_rows in (1000, 20):
        got = embedding_dedup.near_duplicates(frame, cell_rows=cell_rows).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((k, degree[k], found[k], found[k] == k) for k, _ in rows)


def test_embeddings_of_odd_tables(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    none = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(none).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(1, 0, 1, True), (None, 0, None, False), (2, 0, 2, True)], key=str
    )


def test_two_cells_of_embeddings_meet_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    written, write = {}, embedding_dedup.materialize
    monkeypatch.setattr(embedding_dedup, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    embedding_dedup.near_duplicates(frame, cell_rows=20)
    placed = written["cells"].collect()
    home = {r.node: r.cell for r in placed if r.member}
    assert len(home) == 300 < len(placed) and all(r.cell <= home[r.node] for r in placed)


LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def test_events_fold_into_messages(spark):
    log = [
        (1, 1, 1, "open", "user", "he"), (1, 2, 1, "delta", None, "llo"), (1, 2, 1, "delta", None, "llo"),
        (1, 3, 2, "open", "assistant", None), (1, 4, 2, "delta", None, "bad"), (1, 5, 3, "open", "user", "why"),
        (1, 6, 2, "regenerate", None, "go"), (1, 7, 2, "delta", None, "od"), (1, 8, 1, "edit", None, "Hello"), (1, 9, 1, "delta", None, "!"),
        (1, 10, 4, "open", "user", "next"), (1, 11, 4, "other", None, "lost"), (1, 12, None, "delta", None, "lost"),
        (2, 1, 1, "delta", None, "late"), (None, 1, 1, "open", "user", None),
    ]
    frame = spark.createDataFrame([log[k] for k in random.Random(4).sample(range(len(log)), len(log))], LOG)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in messages(frame).collect()}
    assert got == {(1, 1): ("user", "Hello!"), (1, 2): ("assistant", "good"), (1, 4): ("user", "next"), (2, 1): ("", "late"), (None, 1): ("user", "")}
    assert render(messages(spark.createDataFrame([], LOG))).collect() == []


def test_template_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "a\\b \\( <s>[x]", "tail\n", "é🙂" * 9, "\\" * 5 + "<[]"]
    rows = [(c, t, role, text) for c in range(2) for t, (role, text) in enumerate((r, x) for x in texts for r in ("user", "assistant", "a]b<"))]
    rows.append((0, 3, "user", "twice"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in read_back(render(messages(turns_as_events(frame)))).collect():
        own = sorted((t, role, text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss_texts == [text for _, role, text in own if role == "assistant"]
        assert r.formatted.count("</s>") == r.formatted.count("<s>[") == len(own)
    one = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.t == r.back for r in one.select("t", unescaped(escaped(F.col("t"))).alias("back")).collect())


def archive(n=6):
    return [record(k, f"http://a.example/{k} x", f"<p>é {k}</p>WARC/1.1\r\n".encode() * k) for k in range(n)]


def ids_of(found):
    return [int(r.headers["warc-record-id"][10:-1]) for *_, r in found.records]


def test_salvage_inside_members():
    """Many records in one member; the member cut off or damaged; bytes that are no record between them."""
    parts = [record(k, None, f"payload {k} ".encode() * (40 + 7 * k)) for k in range(50)]
    whole = gzip_member(b"".join(parts), 6)
    assert ids_of(salvage(whole)) == list(range(50)) and not salvage(whole).gaps
    cut = salvage(whole[: len(whole) * 3 // 4] + gzip_member(parts[7]))
    assert len(cut.records) > 25 and ids_of(cut) == [*range(len(cut.records) - 1), 7] and len(cut.gaps) == 1
    bad = bytearray(whole)
    bad[len(whole) // 2] ^= 0xFF
    hurt = salvage(bytes(bad) + gzip_member(parts[3]))
    assert len(hurt.records) > 10 and ids_of(hurt)[:-1] == list(range(len(hurt.records) - 1)) and ids_of(hurt)[-1] == 3
    mixed = salvage(gzip_member(parts[0] + b"junk WARC/1.1 junk" + parts[1]))
    assert ids_of(mixed) == [0, 1] and mixed.gaps == [(0, 18, len(parts[0]))]
    stored = gzip_member(b"".join(parts[:5]), 0)
    assert ids_of(salvage(stored[:-6])) == list(range(5))  # each once, though its bytes stand there unpacked


def test_reading_takes_time_in_proportion():
    """Members, false member starts and false version lines: four times the bytes, not sixteen times the work."""
    def seconds(data):
        start = time.perf_counter()
        salvage(data)
        return time.perf_counter() - start

    member = gzip_member(record(1, None, b"some payload " * 20))
    for unit in (member, b"\x1f\x8b\x08 no member ", b"WARC/1.1 no record "):
        small = min(seconds(unit * 2_000) for _ in range(3))
        assert min(seconds(unit * 16_000) for _ in range(2)) < 24 * small + 0.1


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_finds_what_is_left(packed):
    records = archive()
    parts = [gzip_member(r) if packed else r for r in records]
    whole = b"".join(p + EMPTY_MEMBER * packed for p in parts)
    found = salvage(whole)
    assert [r.headers["warc-record-id"] for *_, r in found.records] == [f"<urn:page:{k}>" for k in range(6)] and not found.gaps
    rng = random.Random(8)
    for _ in range(60):
        k = rng.randrange(6)
        at = rng.randrange(12, len(parts[k]) - 8)
        broken = parts[k][:at] + bytes([parts[k][at] ^ 0x55]) + parts[k][at + 1 :]
        junk = rng.randbytes(rng.randrange(0, 9))
        data = b"".join(junk + broken if i == k else p for i, p in enumerate(parts))
        found = salvage(data)
        ids = [r.headers["warc-record-id"] for *_, r in found.records]
        assert [i for i in ids if i in {f"<urn:page:{j}>" for j in range(6)} - {f"<urn:page:{k}>"}] == [f"<urn:page:{j}>" for j in range(6) if j != k]
        covered = sum(n for _, n, _, _ in found.records) + sum(n for _, n, inner in found.gaps if inner is None)
        assert covered == len(data)
    cut = salvage(whole[:-30])
    assert len(cut.records) == 5 and cut.gaps
    assert salvage(b"").records == [] and salvage(b"noise").gaps == [(0, 5, None)]


def test_archives_read_back(spark, tmp_path):
    rows = [(1, "http://x/ä b", "same"), (2, None, "same"), (9, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "öther\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (9, "u", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    write_archives(pages, str(tmp_path / "w"))
    found = read_archives(spark, str(tmp_path / "w")).collect()
    assert {r.kind for r in found} == {"record"} and len(found) == len(rows)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found}
    assert got == {(1, "revisit", 9, 4), (2, "revisit", 9, 4), (9, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0),
                   (5, "response", None, 20), (None, "revisit", 9, 4)}
    for part in (tmp_path / "w").glob("part-*"):
        gzip.decompress(part.read_bytes() or EMPTY_MEMBER)
    write_archives(pages, str(tmp_path / "v"), least=1)
    assert {r.page_id for r in read_archives(spark, str(tmp_path / "v")).where("record_type = 'response'").collect()} == {3, 4, 5, 9}
    write_archives(pages.limit(0), str(tmp_path / "e"))
    assert read_archives(spark, str(tmp_path / "e")).collect() == []


def test_licences(spark):
    plain = [(k, f"{spoken('en', 20, k)}.\n{spoken('fr', 12, k)}\nLicensed users agree") for k in range(60)]
    named = [(100 + k, f"{spoken('en', 9, k)}\n{t}.\n{spoken('de', 9, k)}") for k, t in enumerate(x for v in TEMPLATES.values() for x in v)]
    odd = [(200, None), (201, ""), (None, named[0][1]), (100, named[0][1]), (202, "license " * 3000)]
    found = scan_documents(documents(spark, plain + named + odd)).collect()
    assert len(found) == len(plain) + len(named) + len(odd)
    want = [name for name, v in TEMPLATES.items() for _ in v]
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].families == [] for k, _ in plain)
    right = sum(by_id[100 + k].families == [name] for k, name in enumerate(want))
    assert right == len(want)
    assert by_id[None].families == [want[0]] and by_id[200].n_lines == 0 and by_id[202].families == []
    assert scan_documents(documents(spark, [])).collect() == []


def test_wrapped_and_buried_licences(spark):
    plain = [(k, f"{spoken('en', 20, k)}.\n{spoken('fr', 12, k)}") for k in range(60)]
    long = [(name, v[1]) for name, v in TEMPLATES.items() if len(v[1].split()) > 12]
    wrapped = [(100 + k, spoken("en", 9, k) + "\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t, 70)) + "\n\n" + spoken("de", 9, k)) for k, (_, t) in enumerate(long)]
    buried = [(200 + k, f"{spoken('en', 1500, k)} {t} {spoken('en', 1500, 50 + k)}") for k, (_, t) in enumerate(long)]
    by_id = {r.doc_id: r for r in scan_documents(documents(spark, plain + wrapped + buried)).collect()}
    assert all(by_id[k].families == [] for k, _ in plain)
    for k, (name, _) in enumerate(long):
        assert by_id[100 + k].families == [name] and by_id[200 + k].families == [name]
        assert by_id[200 + k].n_confirmed == 1
