"""Each operator against a plain version, an exact round trip or held-out accuracy, over whole small tables."""
import collections
import cProfile
import heapq
import math
import os
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from countersign.llm import op1_license, op2_neardup, op3_records, op4_toxicity, op6_repetition, op7_mix, op8_language_model, op9_pii, op10_decontaminate, queries
from countersign.llm.text import WordHashes

SF = "/root/testdata/sf0.001"


def read(name, columns="*", sf=SF):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return dict(read("documents", "doc_id, text"))


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def of(name, sf=SF):
        if (name, sf) not in done:
            done[name, sf] = [r.asDict(recursive=True) for r in queries.QUERIES[name](spark, sf).collect()]
        return done[name, sf]

    return of


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(result, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    rel = con.sql(queries.ORACLES[name])
    rows = result(name)
    columns = sorted(rows[0])
    assert sorted(rel.columns) == columns
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    key = lambda rows: sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    assert key(rows) == key(want)


def test_license_templates_are_found(spark):
    rows = [(i, f"Before this. {text.title()}. And after it.") for i, (_, text, _) in enumerate(op1_license.TEMPLATES)]
    rows.append((99, "The license of the mit public software under version."))
    got = {r["doc_id"]: r for r in op1_license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _, _) in enumerate(op1_license.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] > 0.9, (label, got[i])
    assert got[99]["labels"] == "" and got[99]["score"] == 0


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets):
    """Smallest id reachable, from all pairs."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for at, i in enumerate(ids):
        for j in ids[:at]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_all_pairs(result, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = components(sets)
    for r in result("op2_near_duplicates"):
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])


def test_near_duplicate_chains(spark, monkeypatch):
    """A chain of edits, a star and a group of mutual strangers in common buckets; one pivot a round, so that rounds repeat."""
    monkeypatch.setattr(op2_neardup, "PIVOTS", 1)
    random.seed(5)
    words = [f"w{i}" for i in range(200)]
    rows, now = [], list(words)
    for i in range(40):
        rows.append((1000 - i, " ".join(now)))
        now[(i * 37) % 200] = f"x{i}"
    for i in range(30):
        edited = list(words)
        for k in random.sample(range(200), random.randint(1, 8)):
            edited[k] = f"y{i}-{k}"
        rows.append((i, " ".join(edited)))
    random.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    want = components(sets)
    got = {r["doc_id"]: r["component_id"] for r in op2_neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_sketch_agreement_is_similarity():
    rng = np.random.default_rng(1)
    for shared, own in ((900, 50), (300, 300), (6, 1)):
        base = rng.integers(0, 2**63, shared + 2 * own).astype(np.uint64)
        a, b = (op2_neardup.sketch(np.unique(base[x])) for x in (slice(0, shared + own), np.r_[0:shared, shared + own : shared + 2 * own]))
        assert abs((a == b).mean() - shared / (shared + 2 * own)) < 0.15
    for n in (1, 2, 5):
        assert op2_neardup.sketch(np.arange(n, dtype=np.uint64)).max() < np.iinfo(np.uint64).max


def test_records_equal_the_tokenizer(result, texts):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    rows = sorted(result("op3_token_records"), key=lambda r: r["doc_id"])
    for r, (i, text) in zip(rows, sorted(texts.items())):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert r == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_encoder_on_odd_texts():
    random.seed(2)
    pieces = ["a", "_", "$$$", '"', "(b)", "é", "Ñ", "  ", " ", "\n", "\t", ".", ",", "'s", "don't", "1", "x9", "ß", "，", "日本", " ", "\x1c", " ", "é", "🙂", "<|endoftext|>", "!?", "\r\n", "²", "Ⅷ"]
    encoder = op3_records.Encoder(queries.tokenizer_path(), "<u4")
    for _ in range(5000):
        text = "".join(random.choice(pieces) for _ in range(random.randint(0, 9)))
        assert encoder.encode(text) == encoder.plain(text), text


def test_checksums():
    def slow(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert slow(b"123456789") == 0xE3069283
    data = [bytes(random.Random(n).randbytes(n)) for n in (4, 8, 63, 64, 65, 200, 1000)]
    assert list(op3_records.crc32c(data)) == [slow(d) for d in data]


def test_damaged_record_is_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/records"
    op3_records.write_records(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), folder, queries.tokenizer_path())
    assert op3_records.read_records(spark, folder).first()["doc_id"] == 1
    shard = next((tmp_path / "records").glob("*.rec"))
    data = bytearray(shard.read_bytes())
    data[21] ^= 1
    shard.write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        op3_records.read_records(spark, folder).collect()


def test_toxicity_on_held_out_rows(result):
    labels = dict(read("labels", "doc_id, toxic", "/root/testdata/sf0.01"))
    rows = [r for r in result("op4_toxicity", "/root/testdata/sf0.01") if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.93
    for r in result("op4_toxicity", "/root/testdata/sf0.01"):
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_emails_are_those_of_the_pattern():
    """Sought backwards from each @, the same as by leftmost search; runs of a megabyte take no quadratic time."""
    pattern = __import__("re").compile(op9_pii.FORMATS["email"][0])
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("ab.@-_% é1") for _ in range(rng.randint(1, 40)))
        want, got, end = [m.span() for m in pattern.finditer(text)], [], 0
        while m := op9_pii._next_email(pattern, text, end):
            got.append(m.span())
            end = m.end()
        assert got == want, text
    names = op9_pii.Pseudonyms(b"k")
    for text in ("a" * 1_000_000 + " @ x", "a." * 500_000 + " x@y.org", "b" * 1_000_000 + "@", "1 " * 300_000 + "@", "@".join("ab" for _ in range(200_000))):
        started = time.perf_counter()
        names.of(text)
        assert time.perf_counter() - started < 20


def sparse(at, q):
    return dict(zip(at.tolist(), q.tolist()))


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(5)
    terms, rows = 300, []
    for i in range(700):
        at = sorted(set(rng.zipf(1.4, rng.integers(1, 30)).clip(1, terms) - 1))
        rows.append((i, [int(t) for t in at], [int(c) for c in rng.integers(1, 4, len(at))], [1] * int(rng.integers(0, 3)), int(i % 7 == 0)))
    index = op4_toxicity.Index(np.linspace(1, 5, terms), 3.0, rows)
    vectors = [sparse(*index.query(*r[1:4])) for r in rows]
    for i in range(0, 700, 13):
        entries, scores, number = index.nearest(*index.query(*rows[i][1:4]))
        best = sorted((sum(w * v.get(t, 0) for t, w in vectors[i].items()) for v in vectors), reverse=True)[: op4_toxicity.NEIGHBOURS]
        assert np.allclose(np.repeat(scores, np.ceil(number).astype(int))[: len(best)], best, atol=1e-4)
        assert math.isclose(number.sum(), op4_toxicity.NEIGHBOURS)


def test_toxicity_counts_words_of_many_texts_at_once(monkeypatch):
    """The same counts as of each text for itself, and a few calls a text: numbers of words are looked up for all texts together."""
    monkeypatch.setattr(op4_toxicity, "KEPT_WORDS", 40)
    strong, words = ["plan*", "planned*", "bad"], [f"w{i}" for i in range(30)]
    terms, rng = op4_toxicity.Terms(words, strong), random.Random(5)
    pool = [*words, "bad", "planned", "planners", "PLANNING", "plannedly", "planned-ahead", "\u00e9t\u00e9", "a\u3000b", "\ud800"]
    texts = [None, "", " \u00a0 ", *[" ".join(rng.choices([*pool, *(f"x{k}{i}" for i in range(20))], k=k)) for k in range(1, 61)], "plan"]
    for begin in range(0, len(texts), 16):
        some = texts[begin : begin + 16]
        for text, (ids, n, others) in zip(some, terms.count(some), strict=True):
            plain, rest = {}, []
            for word, times in collections.Counter(op4_toxicity.words_of(text)).items():
                for t in op4_toxicity.terms_of(word):
                    if t in terms.at:
                        plain[terms.at[t]] = plain.get(terms.at[t], 0) + times
                if word not in terms.at:
                    rest.append(times)
            assert (dict(zip(ids, n)), list(ids), list(others)) == (plain, sorted(plain), sorted(rest))
        assert sorted(terms.of(some)) == sorted([i for ids, _, _ in terms.count(some) for i in ids] + [-1] * sum(len(o) for _, _, o in terms.count(some)))
    monkeypatch.undo()
    terms.count(texts)
    profile = cProfile.Profile()
    profile.runcall(terms.count, texts)
    assert sum(e.callcount for e in profile.getstats()) < 15 * len(texts)


def test_toxicity_cosines_are_those_of_whole_vectors(spark, result):
    """The query's neighbours against TF-IDF vectors of all words, plainly: every document with every example."""
    docs, labels = dict(read("documents", "doc_id, text")), dict(read("labels", "doc_id, toxic"))
    known = {i: (docs[i], t) for i, t in sorted(labels.items()) if t is not None and i in docs and zlib.crc32(str(i).encode()) % 4 != 2}
    strong = op4_toxicity.learn_terms(spark.createDataFrame(list(known.values()), "text string, toxic int"))
    words = {w for text, _ in known.values() for w in op4_toxicity.words_of(text)}

    def terms(text):
        found = collections.Counter()
        for w in op4_toxicity.words_of(text):
            found.update([w, *(t for t in op4_toxicity.terms_of(w)[1:] if t in strong)])
        return found

    counted = {i: terms(t) for i, t in docs.items()}
    df = collections.Counter(t for c in counted.values() for t in c)
    idf = {t: math.log((len(docs) + 1) / (n + 1)) + 1 for t, n in df.items()}
    strange = op4_toxicity.WEAK * (math.log((len(docs) + 1) / 2) + 1)

    def vector(found):
        v = {t: (1 + math.log(n)) * (idf[t] * (1 if t in strong else op4_toxicity.WEAK) if t in words or t in strong else strange) for t, n in found.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / length for t, x in v.items()}

    vectors = {i: vector(c) for i, c in counted.items()}
    for r in result("op4_toxicity"):
        mine = vectors[r["doc_id"]]
        cosines = {i: sum(x * vectors[i].get(t, 0) for t, x in mine.items() if t in words or t in strong) for i in known}
        best = sorted(cosines.values(), reverse=True)
        if r["evidence"]:
            assert abs(r["similarity"][0] - best[0]) < 2e-4 and all(abs(cosines[e] - s) < 2e-4 for e, s in zip(r["evidence"], r["similarity"]))
        else:
            assert best[0] == 0


def test_copies_of_examples_with_rare_words_are_found(spark):
    """Toxic words that stand in one example each: no term stands out, and still every copy finds its source."""
    clean = [(i, f"plain words about topic{i % 9} and other{i} things", 0) for i in range(300)]
    toxic = [(1000 + i, f"you rareslur{i} of a person, topic{i % 9}", 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in clean + toxic] + [(i + 5000, t) for i, t, _ in toxic] + [(i + 9000, t) for i, t, _ in clean[:20]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + toxic], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in op4_toxicity.score_toxicity(docs, labels).where("doc_id >= 5000").collect()}
    for i, _, _ in toxic:
        assert got[i + 5000]["evidence"][0] == i and got[i + 5000]["similarity"][0] > 0.9999 and got[i + 5000]["predicted"] == 1
    assert all(got[i + 9000]["predicted"] == 0 for i, _, _ in clean[:20])


def test_toxic_recall_on_held_out_rows(result):
    """14 held-out toxic documents of sf0.01; with sf0.1 it is 114 of 120, and 9 of 870 clean ones are taken for toxic."""
    labels = dict(read("labels", "doc_id, toxic", "/root/testdata/sf0.01"))
    rows = [r for r in result("op4_toxicity", "/root/testdata/sf0.01") if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]]]
    assert sum(toxic) >= 0.6 * len(toxic) and sum(r["predicted"] for r in rows if not labels[r["doc_id"]]) <= 1


def test_quality_on_held_out_rows(result):
    labels = dict(read("labels", "doc_id, quality", "/root/testdata/sf0.01"))
    rows = [r for r in result("op5_quality", "/root/testdata/sf0.01") if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and sum(r["kept"] == bool(labels[r["doc_id"]]) for r in rows) / len(rows) > 0.9
    assert all(0 <= r["tail_probability"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)


def slow_repetition(text):
    words = (text or "").encode().split()
    n = len(words)
    spots = [tuple(words[i : i + 3]) for i in range(n - 2)]
    twice = {g for g, k in collections.Counter(spots).items() if k > 1}
    inside = {i + k for i, g in enumerate(spots) if g in twice for k in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            dup += line in lines
            lines.add(line)
    share = 0.0
    chars = sum(len(w.decode()) for w in words)
    for size in range(5, 11):
        seen, cover = set(), set()
        for i in range(n - size + 1):
            g = tuple(words[i : i + size])
            if g in seen:
                cover |= {i + k for k in range(size)}
            seen.add(g)
        share = max(share, sum(len(words[i].decode()) for i in cover) / chars if chars else 0.0)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return {"n_words": n, "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": failed, "dup_gram": share}


def test_repetition_equals_plain_counts(result, texts):
    for r in result("op6_repetition_rules"):
        want = slow_repetition(texts[r["doc_id"]])
        assert {k: plain(r[k]) for k in want} == {k: plain(v) for k, v in want.items()}
        assert not (r["base_failed"] and r["kept"])


def test_repetition_spares_sound_documents(result):
    labels = dict(read("labels", "doc_id, quality", "/root/testdata/sf0.01"))
    rows = [r for r in result("op6_repetition_rules", "/root/testdata/sf0.01") if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in rows) / len(rows) > 0.99


@pytest.mark.parametrize("slots", [{"a": 500, "b": 300, "c": 200, "d": 24}, {f"s{i}": 8 for i in range(128)}, {"x": 1000, "y": 23, None: 1}])
def test_schedule_keeps_every_source_within_a_block(slots):
    period = sum(slots.values())
    assert period == 1024
    rows, done = op7_mix.schedule(slots), collections.Counter()
    assert [r[4] for r in rows] == list(range(period))
    for source, block, release, deadline, slot in rows:
        assert block == done[source] and release <= slot < deadline
        done[source] += 1
        assert all(abs(done[s] - (slot + 1) * n / period) < 1 for s, n in slots.items())


def test_mix_equals_a_running_scheduler(result):
    sources = dict(read("documents", "doc_id, source"))
    counts = collections.Counter(sources.values())
    slots = op7_mix.quantised({s: n**0.7 for s, n in counts.items()}, 1024)
    rows = result("op7_mix_sources")
    assert sorted(r["doc_id"] for r in rows) == sorted(sources)
    # One long run of earliest deadline first, without the period's arithmetic.
    names, want, ready, given = list(slots), {}, [], collections.Counter()
    for slot in range(1024):
        for i, s in enumerate(names):
            while given[s] * 1024 // slots[s] <= slot:
                k = given[s]
                heapq.heappush(ready, (-(-(k + 1) * 1024 // slots[s]), i, k))
                given[s] += 1
        _, i, k = heapq.heappop(ready)
        want[names[i], k] = slot
    for r in rows:
        assert r["source"] == sources[r["doc_id"]] and r["slot"] == want[r["source"], r["block"]]
    sizes = collections.Counter((r["source"], r["block"]) for r in rows)
    for s, n in counts.items():
        assert [sizes[s, k] for k in range(-(-n // 32))] == [min(32, n - 32 * k) for k in range(-(-n // 32))]


def test_language_model_base_counts(result, texts):
    tokens = {i: [*(t or "").encode().lower().split(), b" "] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in result("op8_language_model"):
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(ws), sum(w in c for w in ws))


def test_language_model_beats_unigrams_on_held_out_rows(result):
    rows = [r for r in result("op8_language_model", "/root/testdata/sf0.01") if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_shares_sum_to_one():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(op8_language_model.ROWS, op8_language_model.CLASSES)).astype(np.float32)
    tokens = rng.integers(-(2**62), 2**62, 50)
    place = np.where(rng.random(50) < 0.5, 0, -1)
    cls = op8_language_model.classes(tokens, place)
    rows = op8_language_model.contexts(tokens, place, cls, [20, 1, 29])
    p = op8_language_model.probabilities(weights, np.zeros(op8_language_model.CLASSES, np.float32), rows)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and rows.max() < op8_language_model.ROWS


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_moves_every_value(size):
    moved = op9_pii.Permutation(b"key", "t", size)
    assert sorted(map(moved, range(size))) == list(range(size))
    assert size == 1 or all(moved(i) != i for i in range(size))


def test_pseudonyms_keep_formats_and_links():
    names = op9_pii.Pseudonyms(b"key")
    text = 'Mail a.b-7@Mail.example.com or +1 (017) 555-7713, card 4111 1111 1111 1111, ip 10.20.30.40, born 1980-02-29, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00, token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff".'
    new, counts = names.of(text)
    assert dict(zip(op9_pii.KINDS, counts)) == dict.fromkeys(op9_pii.KINDS, 1)
    assert names.of(new)[1] == counts and len(new.split()) == len(text.split())
    for value in ("a.b-7@", "555-7713", "4111 1111", "10.20.30.40", "1980-02-29", "123-45-6789", "0532 0130", "24be64439e3e"):
        assert value not in new
    again, _ = names.of("Again 10.20.30.40 and 4111111111111111, 29.02.1980.")
    assert new[new.index("ip ") + 3 :].split(",")[0] in again
    for decoy in ("4111111111111112", "10.20.30.400", "1980-02-30", "000-45-6789", "DE88 3704 0044 0532 0130 00"):
        assert names.of(f"See {decoy}.")[0] == f"See {decoy}."


def test_pseudonyms_over_documents(result, texts):
    names = op9_pii.Pseudonyms(b"countersign public demonstration key")
    for r in result("op9_pseudonyms"):
        text, counts = names.of(texts[r["doc_id"]])
        assert r["text"] == text and r["n_found"] == sum(counts)


def slow_align(passage, item):
    h = [[0] * (len(item) + 1) for _ in range(len(passage) + 1)]
    for i, p in enumerate(passage, 1):
        for j, w in enumerate(item, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if p == w else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(6)
    for _ in range(200):
        passage, item = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 20))
        assert op10_decontaminate.align(passage, item)[0] == slow_align(passage.tolist(), item.tolist())


def test_decontamination_equals_all_alignments(result, texts):
    items = {i: op10_decontaminate.words_of(t) for i, t in read("benchmark", "item_id, text")}
    want = set()
    for d, text in texts.items():
        words = op10_decontaminate.words_of(text)
        own = {tuple(words[k : k + 3]) for k in range(len(words))}
        for i, item in items.items():
            # Under three common 3-grams no alignment reaches half of an item here.
            if sum(tuple(item[k : k + 3]) in own for k in range(len(item))) >= 3:
                ids = {w: n for n, w in enumerate({*words, *item})}
                best, _ = op10_decontaminate.align(np.array([ids[w] for w in words]), np.array([ids[w] for w in item]))
                if best / (2 * len(item)) >= 0.5:
                    want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in result("op10_decontaminate")} == want and want


def test_decontamination_finds_edited_copies(spark):
    random.seed(7)
    item = [f"term{i}" for i in range(40)]
    rows = []
    for d in range(20):
        edited = [w for w in item if random.random() > 0.05]
        edited = [f"new{d}x{k}" if random.random() < 0.1 else w for k, w in enumerate(edited)]
        rows.append((d, " ".join([f"a{d}x{k}" for k in range(100)] + edited + [f"b{d}x{k}" for k in range(100)])))
    rows += [(100 + d, " ".join(f"c{d}x{k}" for k in range(100)) + " " + " ".join(item[5:13])) for d in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op10_decontaminate.find_contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == set(range(20))
    assert all(95 <= r["start_word"] <= 115 and r["score"] >= 0.5 for r in found)


def test_word_hashes_forget():
    hashes = WordHashes()
    assert hashes.of([b"a", b"b", b"a"]).tolist() == [hashes[b"a"], hashes[b"b"], hashes[b"a"]]
    assert op6_repetition.repetition("a b", hashes)["n_words"] == 2
