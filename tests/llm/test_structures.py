"""The prefix trie and the Merkle manifest against plain versions, and their edge cases."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from countersign.llm import op11_trie
from countersign.llm.op11_trie import conversation_trie, prefix_trie, read_turns, spliced
from countersign.llm.op12_merkle import LOWER, UPPER, Parent, merkle_manifest

TURNS = "conv_id long, turn long, role string, text string, conv long, pos string, n int, depth string"


def plain_trie(rows, rebuild):
    """The trie by walking every prefix of every conversation."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in by_conv.items()}
    if rebuild:
        built = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            donor = c - (c % 20 if c >= 0 else -(-c % 20))
            built[c] = own.get(donor, [])[:h] + v[h:]
        own = built
    nodes = defaultdict(list)
    for c, v in own.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", p[-1][1])]) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids[p])
    out = set()
    for p, convs in nodes.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(own[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.add((min(convs), len(p), parent, len(convs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, "y") for r in rows], TURNS)


def some_conversations(seed):
    rng, rows = random.Random(seed), []
    for c in list(range(-5, 45)) + [10**12, 10**12 + 1]:
        turns = rng.randint(1, 6)
        for t in range(turns):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d e f"])))
    rows += [(50, t, "u", "chain %d" % (t % 3)) for t in range(300)]
    rows += [(51, t, "u", "chain %d" % (t % 3)) for t in range(200)] + [(51, t, "u", "other") for t in range(200, 260)]
    rows += [(52, t, "u", "chain %d" % (t % 3)) for t in range(300)] + [(53, 0, "u", "chain 0")]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_set(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize(("seed", "small"), [(1, 8192), (2, 60)])
def test_trie_is_the_plain_one(spark, monkeypatch, seed, small):
    """With a small bound the components are split on tables, round by round; blocks of 64 turns make long conversations span several."""
    monkeypatch.setattr(op11_trie, "BLOCK", 64)
    rows = some_conversations(seed)
    turns, convs = spliced(read_turns(frame(spark, rows)))
    assert as_set(prefix_trie(turns, convs, small)) == plain_trie(rows, True)


def test_trie_edges(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, None, "u", "long " * 300_000), (None, 0, "u", "nobody"), (3, 5, None, None), (3, 4, "", "")]
    assert as_set(conversation_trie(frame(spark, rows))) == plain_trie(rows, False)
    assert conversation_trie(frame(spark, [])).collect() == []
    # Conversations that the rebuilding leaves without turns end at the root.
    short = [(c, 0, "u", "t") for c in range(21, 40)]
    turns, convs = spliced(read_turns(frame(spark, short)))
    got = as_set(prefix_trie(turns, convs))
    assert got == plain_trie(short, True) and any(r[1] == 0 and r[3] == 19 for r in got)


def test_ends_of_a_node_pass_in_pieces(spark):
    members = spark.range(500).selectExpr("id as conv", "id % 2 as a", "5L as b", "1L as depth", "1L as n")
    none = spark.createDataFrame([], "conv long, n long")
    got = {r["a"]: r["ends_sha256"] for r in op11_trie._ends(members, none, piece=40).collect()}
    assert got == {a: hashlib.sha256(",".join(str(c) for c in range(a, 500, 2)).encode()).hexdigest() for a in (0, 1)}


def test_decompose_takes_components_apart():
    import numpy as np

    # A path of five nodes in one component, one node in another.
    t = {k: np.array(v, np.int64) for k, v in {
        "comp": [1] * 5 + [9], "comp_depth": [0] * 5 + [4], "rep": [1, 1, 1, 1, 2, 9], "depth": [0, 1, 2, 3, 2, 4], "parent": [0, 1, 1, 1, 1, 1],
        "weight": [9, 7, 3, 1, 2, 5], "leaf": [0, 0, 0, 1, 1, 1], "tokens": [1, 2, 3, 4, 5, 6], "more_leaves": [0, 0, 0, 2, 0, 0], "more_tokens": [0, 0, 0, 0, 0, 10],
    }.items()}
    leaves, tokens = op11_trie.decompose(t)
    assert leaves.tolist() == [2, 2, 1, 3, 1, 1] and tokens.tolist() == [15, 14, 7, 4, 5, 16]


# --- Merkle manifest ---

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string, n long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(row):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, now, sibs):
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            sibs += [x for i, x in enumerate(run) if i != at % 8]
            run[at % 8] = now
            now, at = H(*run), at // 8
        return now

    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for k, v in langs.items()}
    top = tree([trees[k][-1][0] for k in names])
    root, out = top[-1][0], []
    for k in names:
        for at, (_, _, digest, row) in enumerate(sorted(langs[k], key=lambda x: x[:3])):
            other = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                other = (*row[:4], row[4].translate(str.maketrans(UPPER, LOWER)))
            sibs = []
            sub = climb(trees[k], at, leaf(other), sibs)
            folded = climb(top, names.index(k), sub, sibs)
            out.append((row[0], digest, trees[k][-1][0], root, H(*sibs), folded, folded == root))
    return sorted(out, key=repr)


def manifest(spark, rows, **options):
    df = spark.createDataFrame([(*r, "z", 1, "d", 2) for r in rows], DOCS)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle_manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], changed=changed, changes={"text": F.translate("text", UPPER, LOWER)}, **options)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def some_documents(n, langs):
    rng = random.Random(n)
    return [(i * 7 - 50, rng.choice(["s", None, "ü"]), rng.choice(langs), rng.choice([None, i]), rng.choice(["Text %d" % i, "plain", "", None, "ÄÖ É"])) for i in range(n)]


@pytest.mark.parametrize("height", [4, 1])
def test_manifest_is_the_plain_one(spark, height):
    """Blocks of eight make several rounds of blocks out of few rows."""
    rows = some_documents(700, ["en"] * 8 + ["de", None, "", "zz", "é"] + [f"l{i}" for i in range(9)])
    assert manifest(spark, rows, height=height) == plain_manifest(rows)


def test_manifest_edges(spark):
    rows = [(1, "s", "en", 3, "One"), (1, "s", "en", 3, "One"), (1, "s", "en", 4, "Four"), (None, None, "en", None, None), (2, "", None, 0, ""), (3, "s", "x", 9, "Wörd " * 200_000)]
    assert manifest(spark, rows) == plain_manifest(rows)
    assert manifest(spark, rows[:1]) == plain_manifest(rows[:1])
    assert manifest(spark, []) == []


def test_parent_resumes_its_state():
    children = [H(str(i)) for i in range(8)]
    parent = Parent(children)
    assert parent.digest == H(*children)
    assert [parent.folded(i, H("new")) for i in range(8)] == [H(*children[:i], H("new"), *children[i + 1 :]) for i in range(8)]
