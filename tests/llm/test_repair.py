import hashlib
import itertools
import re
import zlib

import pytest

from citeweave.llm import queries, repair

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def exhaustive(rows):
    """Least (cost, audit) over all edit lists with up to three inserts in a gap: no states, no bounds, just every list."""
    best = None
    options = []
    for initial, cut in rows:
        own = [("D", "", 3)]
        if initial:
            own += [("K", initial, int(cut)), ("R", "u", 2 + cut), ("R", "a", 2 + cut)]
        options.append(own)
    gap = [("I" * n, "".join(x), 2 * n) for n in range(3) for x in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*(x for own in options for x in (gap, own)), gap):
        if GOOD.fullmatch("".join(e[1] for e in edits)):
            key = (sum(e[2] for e in edits), "".join(e[0] for e in edits))
            best = key if best is None or key < best else best
    return best


def test_integers_equal_every_edit_list():
    kinds = [("s", False), ("u", False), ("a", False), ("a", True), ("t", False), ("", False), ("u", True)]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.cheapest(list(rows)) == exhaustive(list(rows)), rows
    for rows in list(itertools.product(kinds[:5], repeat=3))[::9]:
        assert repair.cheapest(list(rows)) == exhaustive(list(rows)), rows


def plain(rows):
    """All answers for (conv, turn, role, text) rows, by strings and tuples, each conversation in one list."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [tuple(" " if x is None else str(x) if k < 2 else x for k, x in enumerate(r)) + (r[1],) for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[4] is not None, r[4] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        after = []
        for c, t, role, text, turn in own:
            kind = zlib.crc32(f"{c}:{t}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            after += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        numbers = [t for t, _, _ in after if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults, must, cut = [0, 0, 0], [], []
        for k, (_, role, text) in enumerate(after):
            bare = text.rstrip(SPACE)
            which = 0 if not bare else 1 if (role, text) in [a[1:] for a in after[:k]] else 2 if bare[-1] not in ".!?" else None
            if which is not None:
                faults[which] += 1
            must.append(which in (0, 1))
            cut.append(which == 2)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        # cheapest (cost, audit, roles written) of each end of the roles written, from the first row on: whole strings, all kept
        import heapq

        heap, done, best = [(0, "", 0, "", "")], set(), None
        while heap:
            cost, audit, k, written, repaired = heapq.heappop(heap)
            if best is not None and cost > best[0]:
                break
            if k == len(after) and GOOD.fullmatch(written) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, repaired)
            if (k, written, audit) in done or not GOOD.match(written) or not (GOOD.fullmatch(written) or GOOD.fullmatch(written + "ua") or GOOD.fullmatch(written + "a")):
                continue
            done.add((k, written, audit))
            for name in ("user", "assistant"):
                if not audit.endswith("II"):
                    heapq.heappush(heap, (cost + 2, audit + "I", k, written + name[0], repaired + f"\n{name}:"))
            if k < len(after):
                _, role, text = after[k]
                heapq.heappush(heap, (cost + 3, audit + "D", k + 1, written, repaired))
                if not must[k]:
                    heapq.heappush(heap, (cost + cut[k], audit + "K", k + 1, written + role[:1], repaired + f"\n{role}:{text}"))
                    for name in ("user", "assistant"):
                        heapq.heappush(heap, (cost + 2 + cut[k], audit + "R", k + 1, written + name[0], repaired + f"\n{name}:{text}"))
        sha = hashlib.sha256(best[2][1:].encode()).hexdigest()
        out[conv] = (gaps, *faults, illegal, best[0], best[1], sha)
    return out


def answers(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_matches_brute_force(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    want = plain(rows)
    assert answers(queries.QUERIES["op13_conversation_repair"](spark, sf)) == want and sum(w[5] for w in want.values()) > 20


def test_odd_rows(spark):
    rows = [(1, None, "user", "Hi."), (1, 0, None, "x."), (1, 0, "assistant", None), (1, 3, "assistant", "y!"), (1, 3, "assistant", "y!"), (1, 9, "user", " \n"),
            (None, 1, "user", "a."), (None, 2, "assistant", "b"), (2, None, None, None), (3, 5, "", ""), (4, 1, "system", "s."), (5, 2, "user", "w. " * 2000)]
    rows += [(6, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(12)] + [(c, 0, "user", "q?") for c in range(7, 40)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, gaps int, place string")
    got = answers(repair.repair(df))
    assert got == plain(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert any(g == (0, 0, 0, 0, 0, 0, "", empty) for g in got.values())  # a dropped row was the only one
    assert repair.repair(df.limit(0)).collect() == []


def test_long_conversation():
    """Integers of 20,000 bits: the repair is valid and no dearer than deleting every row that breaks the order."""
    rows = [(("u", "a", "a", "s", "u")[k * k % 5], k % 7 == 0) for k in range(2500)]
    cost, audit = repair.cheapest(rows)
    state, at, paid = repair.NONE, 0, 0
    for letter in audit:
        if letter != "I":
            initial, cut = rows[at]
            at += 1
        paid += {"D": 3, "I": 2, "K": 0, "R": 2}[letter] + (letter in "KR" and cut)
        if letter != "D":
            role = initial if letter == "K" else repair.MADE[state][0]
            state = repair.WRITES[role][state]
    assert at == len(rows) and paid == cost and state in (repair.NONE, repair.ASSISTANT) and cost <= 2 * len(rows)
