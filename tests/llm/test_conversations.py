"""The trie of prefixes and the repair of structure against plain versions and DuckDB."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import duck

from vecfolio.llm import prefix_trie, repair
from vecfolio.llm.queries import ORACLE_SQL, QUERIES

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = {
    "op12_prefix_trie": "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256",
    "op13_structure_repair": "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256",
}


def made_turns(seed, n, most=6):
    """Conversations of few words, so that prefixes, faults and ties are common."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 4 * n), n):
        turns = [r.choice([None, *range(12)]) for _ in range(r.randint(1, most))]
        rows += [(c, t, r.choice(["user", "assistant", "assistant", "system", "tool", "", None]), r.choice(["a.", "a b", "b c d!", "", " \t", None, "end?  \n"])) for t in turns]
    deep = [(20, t, "user" if t % 2 == 0 else "assistant", f"deep {t}.") for t in range(60)]
    return rows + deep + [(21, *x[1:]) for x in deep[:40]] + [(27, *x[1:]) for x in deep] + [(40, t, *x[2:]) for t, x in enumerate(deep)]


def written(spark, rows, folder):
    spark.createDataFrame([(*r, "x", 1) for r in rows], f"{TURNS}, depth string, words int").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(who) if len(whole[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(tuple((v is not None, v) for v in r) for r in rows)


def found(spark, name, folder):
    return in_order(QUERIES[name](spark, folder).select(*COLUMNS[name].split(", ")).collect())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_as_sql(spark, small, tmp_path, name):
    for folder in (small, written(spark, made_turns(1, 60), tmp_path)):
        wanted = duck(folder, ["conversations"]).execute(f"SELECT {COLUMNS[name]} FROM ({ORACLE_SQL[name]})").fetchall()
        assert found(spark, name, folder) == in_order(wanted)


def test_trie_by_hand(spark, tmp_path):
    rows = [*made_turns(2, 80), (None, 1, "user", "a.")]
    assert found(spark, "op12_prefix_trie", written(spark, rows, tmp_path)) == in_order(plain_trie(rows))


def test_hot_and_cold_nodes(spark, tmp_path, monkeypatch):
    rows = made_turns(3, 60)
    folder = written(spark, rows, tmp_path)
    for hot in (3, 10**9):  # few nodes are hot; all are
        monkeypatch.setattr(prefix_trie, "HOT", hot)
        assert found(spark, "op12_prefix_trie", folder) == in_order(plain_trie(rows))


def test_ends_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 1)
    ids = [-5, -4, -1, 0, 1, 2, 3, 9, 10, 100]
    rows = spark.createDataFrame([(c, 7, 2, True) for c in ids] + [(4, 7, 2, False)], "conv_id long, owner long, depth int, last boolean")
    assert prefix_trie.ends(rows).collect()[0]["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def cheapest(rows):
    """(cost, audit, lines) by trying all edits with at most three inserts in a row."""
    states = {"": (0, "", ())}  # initials so far: the best way there
    inserts = [w for n in range(4) for w in itertools.product(("user", "assistant"), repeat=n)]

    def add(to, initials, way):
        if re.fullmatch(r"(s?(ua)*u?)?", initials):
            short = re.sub(r"(ua)+", "ua", initials)
            if short not in to or way[:2] < to[short][:2]:
                to[short] = way

    def filled(states):
        to = {}
        for initials, (cost, audit, lines) in states.items():
            for w in inserts:
                add(to, initials + "".join(x[0] for x in w), (cost + 2 * len(w), audit + "I" * len(w), lines + tuple(f"{x}:" for x in w)))
        return to

    for role, text, gone, truncated in rows:
        to = {}
        for initials, (cost, audit, lines) in filled(states).items():
            add(to, initials, (cost + 3, audit + "D", lines))
            if not gone:
                add(to, initials + (role[:1] or "-"), (cost + truncated, audit + "K", lines + (f"{role}:{text}",)))
                for x in ("user", "assistant"):
                    add(to, initials + x[0], (cost + 2 + truncated, audit + "R", lines + (f"{x}:{text}",)))
        states = to
    ends = [way for initials, way in filled(states).items() if re.fullmatch(r"(s?(ua)+)?", initials)]
    return min(ends)


def test_repair_by_search():
    r = random.Random(4)
    automaton = repair.RepairAutomaton()
    for _ in range(400):
        rows = [(r.choice(["user", "assistant", "system", "", "tool", "usher"]), f"t{i}", r.random() < 0.2, int(r.random() < 0.3)) for i in range(r.randint(0, 7))]
        symbols = bytes(0 if gone else repair.SYMBOLS.index((role[:1] if role[:1] in ("s", "u", "a") else "", cut)) for role, _, gone, cut in rows)
        cost, states = automaton.scan(symbols)
        edits = "".join(automaton.trace(symbols, states))
        wanted = cheapest(rows)
        assert (cost, edits[::2]) == wanted[:2]
        lines, left = [], iter(rows)
        for letter, role in zip(edits[::2], edits[1::2]):
            given = {"u": "user", "a": "assistant"}.get(role)
            row = None if letter == "I" else next(left)
            if letter != "D":
                lines.append(f"{row[0] if letter == 'K' else given}:{row[1] if row else ''}")
        assert tuple(lines) == wanted[2]
    assert len(automaton.vectors) < 60


def test_repair_of_a_long_conversation(spark, tmp_path):
    rows = [(5, t, ("user", "assistant", "tool")[t * t % 7 % 3], f"said {t}" + "." * (t % 4 > 0)) for t in range(30_000)]
    folder = written(spark, rows, tmp_path)
    got = QUERIES["op13_structure_repair"](spark, folder).collect()
    assert len(got) == 1 and got[0]["cost"] > 0 and len(got[0]["audit"]) > 28_000


def test_all_rows_dropped(spark, tmp_path):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    folder = written(spark, [(c, t, "user", "hi.") for c, t in gone], tmp_path)
    rows = QUERIES["op13_structure_repair"](spark, folder).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r[c] for c in COLUMNS["op13_structure_repair"].split(", ")) for r in rows) == sorted((c, 0, 0, 0, 0, 0, 0, "", empty) for c, _ in gone)
