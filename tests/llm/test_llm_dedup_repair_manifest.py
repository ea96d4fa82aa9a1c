"""Exact dedup, structure repair and Merkle manifest against brute force, on odd rows and on empty tables."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parityspark.llm import op11_exact_dedup, op12_structure_repair, op13_merkle_manifest
from parityspark.llm.common import remainder

CLASH = ("row", "n", "len", "keep_id", "kept", "slot", "tree", "node", "path", "at", "gone_", "word", "points", "ck", "block", "tie")


def with_extra(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# --- exact dedup ----------------------------------------------------------------------------------------------------

LONG = " ".join(f"w{i}" for i in range(60_000))
TEXTS = [
    (1, "a b c"), (2, "abc"), (3, "a\tb\r\nc \x0b\x0c"), (4, "abd"), (5, None), (6, ""), (7, " \n"), (8, LONG), (9, LONG.replace(" ", "\n\n")), (10, LONG[:-1] + "X"),
    (None, "abc  "), (None, None), (2, "abc"), (2, "abc"), (11, "é x"), (12, "éx"), (13, "x" * 70 + "a"), (14, "x" * 70 + "b"), (15, "x" * 70 + "a"),
]


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups["".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for _, _, _, i in members:
            out.append((rows[i][0], rows[best[3]][0], len(members), best[3] == i, hashlib.sha256(norm.encode()).digest()))
    return out


def key(r):
    return tuple((v is None, v if v is not None else 0) for v in r)


@pytest.mark.parametrize("hot", [1000, 4, 1])
def test_dedup_equals_brute_force(spark, hot):
    docs = with_extra(spark.createDataFrame(TEXTS, "doc_id long, text string")).repartition(4)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.sha256)) for r in op11_exact_dedup.dedup(docs, all_digests=True, hot=hot).collect()]
    assert sorted(got, key=key) == sorted(brute_dedup(TEXTS), key=key)


def test_dedup_hashes_only_texts_that_may_have_an_equal(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {(r.doc_id, r.sha256 is None) for r in op11_exact_dedup.dedup(docs).collect()}
    assert {(4, True), (11, True), (12, True)} <= got  # alone by length or by prefix
    assert {(1, False), (8, False), (13, False), (14, False)} <= got  # 14 shares length and prefix with 13, not the text


def test_dedup_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op11_exact_dedup.dedup(docs, all_digests=True).count() == 0


# --- structure repair -----------------------------------------------------------------------------------------------


def brute_cheapest(pattern, entry=0, exits=(0, 3)):
    """Least (cost, audit) by row-wise dynamic programming with up to two inserts between rows."""
    r = op12_structure_repair
    now = {entry: (0, "")}

    def insert(now):
        for _ in range(3):
            for q, e, t, w in r.INSERTS:
                if q in now:
                    now[t] = min(now.get(t, (10**9, "")), (now[q][0] + w, now[q][1] + e))
        return now

    for c in pattern:
        nxt = {}
        insert(now)
        for q, e, t, w in r.row_edits(c):
            if q in now:
                nxt[t] = min(nxt.get(t, (10**9, "")), (now[q][0] + w, now[q][1] + e))
        now = nxt
    insert(now)
    found = [now[q] for q in exits if q in now]
    return min(found) if found else None


def test_bidirectional_search_finds_the_least_audit():
    r, rng = op12_structure_repair, random.Random(7)
    codes = [r.code(i, f) for i in "suax" for f in range(4)]
    for pattern in ("", *codes, *(a + b for a in codes for b in codes)):
        assert r.cheapest(pattern) == brute_cheapest(pattern)
    for _ in range(400):
        pattern = "".join(rng.choice(codes) for _ in range(rng.randrange(3, 14)))
        assert r.cheapest(pattern) == brute_cheapest(pattern)
        for q in range(4):
            for t in range(4):
                assert r.cheapest(pattern, q, (t,)) == brute_cheapest(pattern, q, (t,))


def test_every_edit_sequence_of_short_conversations():
    """Against all edit sequences with at most two inserts, spelled out."""
    r = op12_structure_repair
    codes = [r.code(i, f) for i in "sua" for f in (0, 1, 3)]
    for pattern in itertools.product(codes, repeat=3):
        best = None
        for audit in {"".join(p) for k in range(3) for p in set(itertools.permutations("I" * k + "123", 3 + k)) if [c for c in p if c != "I"] == list("123")}:
            for edits in itertools.product("DKR", repeat=3):
                states, cost, text = {0}, 0, ""
                for c in audit:
                    if c == "I":
                        e, w = "I", 5
                        states = {t for q, _, t, _ in r.INSERTS if q in states}
                    else:
                        e = edits[int(c) - 1]
                        ways = [(q, t, w) for q, k, t, w in r.row_edits(pattern[int(c) - 1]) if k == e and q in states]
                        states, w = {t for _, t, _ in ways}, max((w for _, _, w in ways), default=0)
                    cost, text = cost + w, text + e
                if states & {0, 3} and (best is None or (cost, text) < best):
                    best = (cost, text)
        assert r.cheapest("".join(pattern)) == best


def conversations():
    rng = random.Random(3)
    rows = [
        (1, 0, "system", "Be good."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Yes."), (2, 5, "user", "no end"), (2, None, "system", "Sys."), (2, 9, "assistant", " \n"),
        (None, 1, "user", "Null one."), (None, None, None, None), (3, 1, None, None), (4, 0, "user", "x!"), (4, 0, "user", "x!"), (4, 0, "assistant", "y."), (5, 3, "", "z."), (6, 1, "user", "q." * 20_000),
        (7, 2, "assistant", "Only."), (9, 0, "tool", "T."), (9, 1, "user", "U."), (9, 2, "assistant", "A.  \t"),
    ]
    return rows + [(50, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two", "", "Three!", f"Four {t}."])) for t in range(0, 400, 2)]


def brute_repair(rows):
    """``rows`` (conv_id, turn, role, text, gone)."""
    r = op12_structure_repair
    convs = defaultdict(list)
    for conv, turn, role, text, gone in rows:
        convs[conv]
        if not gone:
            role, text = " " if role is None else role, " " if text is None else text
            convs[conv].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    out = {}
    for conv, members in convs.items():
        members.sort()
        seen, pattern = set(), ""
        for _, _, role, _, text in members:
            solid = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 3
            seen.add((role, text))
            pattern += r.code(role[:1], fault)
        cost, audit = brute_cheapest(pattern)
        said, q, i = [], 0, 0
        for e in audit:
            role, text = (None, "") if e == "I" else (members[i][2], members[i][4])
            i += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if q == 2 else "user"
            q = r.STEP[q, role[0]]
            said.append(f"{role}:{text}")
        turns = [m[1] for m in members if m[0]]
        initials = [m[2][:1] for m in members]
        faults = [(ord(c) - 65) % 4 for c in pattern]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


@pytest.mark.parametrize("limits", [{}, {"whole": 2, "block": 3, "fan": 2}, {"whole": 0, "whole_bytes": 0, "block": 8}])
def test_repair_equals_brute_force_whole_and_in_blocks(spark, limits):
    rows = [(*r, False) for r in conversations()] + [(8, 1, "user", "gone.", True), (50, 3, "user", "gone too.", True)]
    df = with_extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")).repartition(3)
    got = op12_structure_repair.repair(df, **limits).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute_repair(rows)
    assert len(got) == len({r[0] for r in rows})


def test_damage_follows_the_key(spark):
    rows = [(c, t, "assistant", "a. b!") for c in range(20) for t in range(6)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in op12_structure_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id, r.turn].append((r.role, r.text, r.gone))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [(role, text, True)], 1: [(role, "", False)], 2: [(role, "a b" if c is not None else " ", False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert got[c, t] == want.get(kind, [(role, text, False)])


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op12_structure_repair.repair(df).count() == 0


# --- Merkle manifest ------------------------------------------------------------------------------------------------


def sha(*values):
    return hashlib.sha256("".join(values).encode()).hexdigest()


def brute_leaf(doc, text, lang, source, n):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, slot, node):
    path = []
    for level in levels[:-1]:
        pair = level[slot // 2 * 2 : slot // 2 * 2 + 2]
        path += [x for i, x in enumerate(pair) if i != slot % 2]
        pair[slot % 2] = node
        node, slot = sha(*pair), slot // 2
    return node, path


def brute_manifest(rows):
    trees = defaultdict(list)
    for doc, text, lang, source, n in rows:
        tampered = n + 1 if doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0 else n
        trees[lang].append((doc is not None, doc or 0, brute_leaf(doc, text, lang, source, n), brute_leaf(doc, text, lang, source, tampered)))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for lang in order:
        trees[lang].sort()
        levels[lang] = brute_tree([m[2] for m in trees[lang]])
    over = brute_tree([levels[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for slot, (known, doc, leaf, held) in enumerate(trees[lang]):
            sub, path = climb(levels[lang], slot, held)
            root, rest = climb(over, at, sub)
            out.append((doc if known else None, leaf, levels[lang][-1][0], over[-1][0], sha(*path, *rest), root, root == over[-1][0]))
    return out


def documents(n):
    rows = [(i * 37 % 1001 - 300, f"text {i}", ["en", "de", None, "Zz", "é"][i % 5 if i % 3 else 0], "s", i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "a", "en", None, 3), (None, "a", "en", None, 3), (2**62, LONG, "en", "s", 1), (-(2**63), "", "en", "", 0), (63, "bit", "en", "s", 4), (-1, "minus", "fr", "s", 5), (5, "dup", "en", "s", 1), (5, "dup", "en", "s", 1), (5, "other", "en", "s", None)]


@pytest.mark.parametrize("n,levels", [(150, 10), (150, 2), (60, 1), (0, 3)])
def test_manifest_equals_brute_force(spark, n, levels):
    rows = documents(n)
    docs = with_extra(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).repartition(3)
    changed = F.when(remainder(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1)
    got = op13_merkle_manifest.manifest(docs, changed, levels).collect()
    got = [(r.doc_id, *[bytes(x).hex() for x in (r.leaf, r.subroot, r.root)], r.proof_sha256, bytes(r.folded_root).hex(), r.verified) for r in got]
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_one_row_and_of_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (one,) = op13_merkle_manifest.manifest(spark.createDataFrame([(7, "t", "en", "s", 1)], schema)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == hashlib.sha256().hexdigest()
    assert op13_merkle_manifest.manifest(spark.createDataFrame([], schema)).count() == 0
