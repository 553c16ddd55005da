"""The prefix trie, the Merkle manifest and SuperMinHash against brute force and SQL, with awkward rows."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import same
from tessella.llm import merkle, supermin, trie
from tessella.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle", "op13_superminhash"])
def test_query_equals_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], FOLDER)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# The trie


def trie_of(rows):
    """Nodes as the query returns them, by plain recursion over prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), role, sha(f"{len(role.encode())}:", role, text), text))
    turns = {c: [(t[1], t[3]) for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members = {}
    for c, own in built.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in below)]
        ends = ",".join(str(c) for c in sorted(own) if len(built[c]) == len(node))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), sum(len(n) == len(node) + 1 for n in below), len(leaves),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), sha(ends),
        ))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def nodes(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)


def awkward_conversations():
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t}") for c in (100, 101, 103, 250, 251) for t in range(c % 7 + 1)]
    rows += [(107, 0, None, None), (107, None, "user", "first"), (107, 1, "user", "é" * 9), (109, 5, "user", "tie"), (109, 5, "bot", "tie"), (109, 5, "bot", "tie"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(9)] + [(400, t, "user", f"long {t % 3}") for t in range(70)] + [(401, t, "user", f"long {t % 3}") for t in range(64)]
    return rows + [(503, 0, "u", "one turn, taken away")] + [(0, 0, "u", ""), (1, 0, "u", ""), (-1, 0, "u", "below")]


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = awkward_conversations()
    want = trie_of(rows)
    assert nodes(conversations(spark, rows)) == want
    monkeypatch.setattr(trie, "SEGMENT", 5)  # conversations over many segments
    monkeypatch.setattr(trie, "PIECE_BYTES", 8)  # ends in many pieces
    wider = conversations(spark, rows).withColumns({"depth": F.lit(1), "q": F.lit(2), "a.b": F.lit(3), "owner": F.create_map(F.lit("a"), F.lit(1))})
    assert nodes(wider.repartition(7)) == want


def test_trie_of_nothing(spark):
    assert nodes(conversations(spark, [])) == []
    assert nodes(conversations(spark, [(None, 1, "u", "x")])) == []


# The manifest


def tree_of(rows):
    """(root, {place: (proof digest, folded root)}) of rows (place, group, order, digest, claimed)."""

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    groups = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[2] is not None, r[2] or 0, r[3])):
        groups.setdefault(row[1], []).append(row)
    trees = {g: levels([r[3] for r in own]) for g, own in groups.items()}
    top = levels([t[-1][0] for t in trees.values()])
    out = []
    for number, (g, own) in enumerate(groups.items()):
        for i, row in enumerate(own):
            now, used, at = row[4], [], i
            for level, place in [(x, i >> k) for k, x in enumerate(trees[g][:-1])] + [(x, number >> k) for k, x in enumerate(top[:-1])]:
                run = level[place - place % 2 : place - place % 2 + 2]
                used += [s for k, s in enumerate(run) if k != place % 2]
                run[place % 2] = now
                now = sha(*run)
            out.append((row[0], row[3], trees[g][-1][0], top[-1][0], sha(*used), now, now == top[-1][0]))
    return out


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def awkward_documents():
    rows = [(i, f"text {i}", ["de", "en", None, "éa", ""][i % 5], f"s{i % 3}", i) for i in range(45)] + [(i, "x" * i, "one", None, None) for i in range(100, 137)]
    rows += [(200, "alone", "zz", "s", 5), (7, None, "en", None, None), (None, "no id", "en", "s", 1), (None, None, None, None, None), (9, "twice", "de", "s", 2), (9, "twice", "de", "s", 2), (49, "Ü" * 40_000, "de", "s", 2**63 - 1)]
    return rows


def test_manifest_equals_brute_force(spark, monkeypatch):
    rows = awkward_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bent = lambda d: d[0] is not None and d[0] % 4 == 1
    held = []
    for d in rows:
        leaf = lambda n, d=d: sha(*map(field, (d[0], d[3], d[2], n, d[1])))
        more = None if d[4] is None or d[4] == 2**63 - 1 else d[4] + 1
        held.append((d[0], d[2], d[0], leaf(d[4]), leaf(more) if bent(d) else leaf(d[4])))
    want = sorted(tree_of(held), key=str)

    def got(docs):
        out = merkle.audit_documents(docs, F.col("doc_id") % 4 == 1)
        return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified").collect()), key=str)

    assert got(docs) == want
    monkeypatch.setattr(merkle, "SPAN", 2)  # several floors of paths
    monkeypatch.setattr(merkle, "MAX_NODES", 3)  # rounds by spans before treeReduce
    wider = docs.withColumns({"tree": F.lit(1), "index": F.lit(2), "path": F.lit("x"), "a.b": F.lit(3), "m": F.create_map(F.lit("a"), F.lit(1))})
    assert got(wider.repartition(5)) == want
    assert got(docs.limit(0)) == []


def test_forests_merge_in_any_order():
    leaves = [("t", 23, 0, i, sha(str(i))) for i in range(23)]
    whole = merkle.Forest().add(leaves).resolve().unresolved()
    assert len(whole) == 1 and whole[0][2] == merkle.height(23)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        parts = [merkle.Forest().add([leaves[i] for i in own]).resolve() for own in np.array_split(rng.permutation(23), 6)]
        while len(parts) > 1:
            parts = [parts[0].merge(parts[1]), *parts[2:]] if rng.integers(2) else [*parts[:-2], parts[-2].merge(parts[-1])]
        assert parts[0].unresolved() == whole


# SuperMinHash


def super_minhash_one_by_one(elements, slots):
    """The signature by a shuffle of the slots for each element, one after another."""
    out = [int(supermin.UNSET)] * slots
    for e in elements:
        order = list(range(slots))
        for level in range(slots):
            draw = int(supermin.mix(np.array([e], np.uint64) + supermin.mix(np.array([level + 1], np.uint64)))[0])
            pick = level + (((draw & 0xFFFFFFFF) * (slots - level)) >> 32)
            order[level], order[pick] = order[pick], order[level]
            out[order[level]] = min(out[order[level]], (level << 32) | (draw >> 32))
    return out


def test_signatures(spark):
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 7, 0, 40, 300)]
    got = supermin.super_minhash(np.concatenate(sets), np.array([len(s) for s in sets]), 24)
    for own, row in zip(sets, got):
        assert row.tolist() == super_minhash_one_by_one(own, 24)


def test_slots_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(60):
        shared, mine, theirs = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (40, 10, 10))
        a, b = supermin.super_minhash(np.concatenate([shared, mine, shared, theirs]), np.array([50, 50]), 80)
        errors.append((a == b).mean() - 40 / 60)
    plain = np.sqrt(40 / 60 * 20 / 60 / 80)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < plain  # a lower variance than 80 independent functions


def words(text):
    return [w for w in (text or "").lower().encode().split()]


def near_of(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = (min(keys) if keys else None) if sets[i] else key
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=str)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, n)) for n in (6, 12, 30, 80, 200, 700)]
    rows, key = [], 0
    for own in base:
        for copy in range(25):
            changed = list(own)
            for _ in range(int(len(own) * rng.choice([0, 0.02, 0.05, 0.08]))):
                changed[rng.integers(len(own))] = f"x{rng.integers(50)}"
            rows.append((key, ("  " if copy % 3 else "\t\n").join(changed)))
            key += 1
    rows += [(900, None), (901, ""), (902, " \t"), (903, "Word"), (904, "word"), (905, "a b"), (906, "A\x0bB"), (None, "a b"), (None, "only this one here"), (None, "only this one here"), (905, "a b"), (908, "b " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in supermin.shingle_duplicates(df).collect()), key=str)
    assert got == near_of(rows)
    wider = df.withColumns({"key": F.lit(1), "item": F.lit(2), "a.b": F.lit(3), "m": F.create_map(F.lit("a"), F.lit(1))})
    assert sorted((tuple(r) for r in supermin.shingle_duplicates(wider.repartition(5)).collect()), key=str) == got
    assert supermin.shingle_duplicates(df.limit(0)).collect() == []


def test_distinct_shingles():
    found, count = supermin.distinct_shingles(pa.array([b"a b a b", b"", b"x", b"A B"], pa.binary()), 2)
    assert count.tolist() == [2, 0, 1, 1] and found[3] in found[:2]
