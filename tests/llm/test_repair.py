import hashlib
import heapq
import random
import time
import zlib
from collections import Counter, defaultdict

import pytest

from contestlab.llm import repair
from contestlab.llm.repair import BLANK, CUT, DUPLICATE, INITIALS, KINDS, OTHER, SOUND

SCHEMA = "conv_id long, turn long, role string, text string, pos long, n string"


def brute(roles, faults):
    """Cost and audit by uniform-cost search over whole audits; roles: initials, faults: '', b, d or t."""
    heap, done = [(0, "", 0, "")], set()  # cost, audit, rows done, initials left
    while heap:
        cost, audit, at, left = heapq.heappop(heap)
        tail = left[-2:] if len(left) > 1 or not left else "^" + left
        if at == len(roles) and (not left or left[-1] == "a"):
            return cost, audit
        if (at, tail) in done:
            continue
        done.add((at, tail))
        fits = lambda x: x == "s" and not left or x == "u" and (not left or left[-1] in "sa") or x == "a" and left[-1:] == "u"
        for x in "ua":
            if fits(x):
                heapq.heappush(heap, (cost + 2, audit + "I", at, left + x))
        if at < len(roles):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, left))
            if faults[at] not in ("b", "d"):
                more = faults[at] == "t"
                if fits(roles[at]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, left + roles[at]))
                for x in "ua":
                    if fits(x):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, left + x))
    raise AssertionError


def code(role, fault):
    return (INITIALS.index(role) if role in INITIALS else OTHER) * KINDS + {"": SOUND, "b": BLANK, "d": DUPLICATE, "t": CUT}[fault]


def test_search_equals_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randrange(0, 12)
        roles, faults = [rng.choice("suaauux") for _ in range(n)], [rng.choice(["", "", "", "b", "d", "t"]) for _ in range(n)]
        assert repair.cheapest([code(*x) for x in zip(roles, faults, strict=True)]) == brute(roles, faults)


def test_audits_compare_as_their_texts():
    rng, audits = random.Random(1), repair.Audits()
    known = {"": 0}
    for _ in range(3000):
        parent = rng.choice(list(known)) if rng.random() < 0.3 else max(known, key=len)
        word = parent + rng.choice("DIKR")
        if word not in known:
            known[word] = audits.add(known[parent], word[-1])
    words = rng.sample(list(known), 300)
    assert all(audits.spell(known[w]) == w for w in words)
    for a, b in zip(words, reversed(words), strict=True):
        if a != b:
            assert (audits.compare(known[a], known[b]) < 0) == (a < b)


def test_long_conversations_take_time_in_proportion():
    rng = random.Random(8)
    took = []
    for n in (2_000, 20_000):
        codes = [code("ua"[i % 2] if rng.random() < 0.9 else rng.choice("suax"), rng.choice(["", "", "", "", "b", "d", "t"])) for i in range(n)]
        t = time.perf_counter()
        cost, audit = repair.cheapest(codes)
        took.append(time.perf_counter() - t)
        assert len(audit) - audit.count("I") == n and cost >= repair.remaining(codes)[0]
    assert took[1] < 40 * took[0] + 1


def plain(rows):
    """The contract in plain Python over (conv_id, turn, role, text), without damage."""
    out, convs = {}, defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, " " if r is None else r, " " if x is None else x))
    for c, found in convs.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, r, x in found:
            bare = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((r, x))
        roles = [r[:1] if r[:1] in tuple("sua") else "x" for _, r, _ in found]
        cost, audit = brute(roles, faults)
        lines, at, last = [], 0, ""
        for e in audit:
            turn = "assistant" if last == "u" else "user"
            if e in "KRI":
                role = found[at][1] if e == "K" else turn
                lines.append(f"{role}:{'' if e == 'I' else found[at][2]}")
                last = role[0]
            at += e != "I"
        turns = [t for t, *_ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        n = Counter(faults)
        out[c] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if d:
            x = "" if d == 1 else "".join(ch for ch in x if ch not in ".!?") if d == 2 else x
            out += [(c, t, "user" if d == 4 else r, x)] * (2 if d == 3 else 1)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA)


def corpus():
    rng, rows = random.Random(2), []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant"]) if t else "system", f"Text {rng.randrange(6)}{rng.choice(['.', '!', ' ?', ', ', ''])}"))
    rows += [(None, 1, "user", "Null id."), (None, None, None, None), (100, None, "user", "No turn."), (100, None, "assistant", "None either."), (100, 3, "", "No role."), (101, 1, "user", ""), (102, 1, "user", "ü 日本 \x00 ")]
    return rows + [rows[3]] * 2 + [(103, 1, "user", "Long. " * 50_000)]


@pytest.mark.parametrize("lines", [256, 2])
def test_repair_equals_plain_python(spark, monkeypatch, lines):
    monkeypatch.setattr(repair, "LINES", lines)
    rows = corpus()
    df = frame(spark, rows)
    for got, want in ((repair.repair(df), plain(rows)), (repair.repair(df, repair.damage(df)), plain(damaged(rows)))):
        found = {r[0]: tuple(r)[1:] for r in got.collect()}
        assert set(found) == {r[0] for r in rows}
        for c, row in found.items():
            assert row == want.get(c, (0, 0, 0, 0, 0, 0, "", repair.EMPTY)), c


def test_one_conversation_of_many_rows(spark):
    """Most rows are of one conversation, and many of these are copies; its lines reach over many blocks."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"Turn {i}{'.' if i % 5 else ''}") for i in range(1500)] + [(1, 700, "user", "Copy.")] * 500 + [(i, 0, "user", "Hi.") for i in range(2, 60)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(frame(spark, rows)).collect()}
    assert got == plain(rows)


def test_turns_out_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "cut"), (1, 2, "user", " ")]
    lines = repair.Repair(frame(spark, rows)).lines.orderBy("conv_id", "at").collect()
    assert [(r.at, r.role, r.text) for r in lines] == [(0, "user", "Hello."), (1, "assistant", "cut")]
    assert repair.repair(frame(spark, rows).limit(0)).count() == 0
    df = frame(spark, rows)
    nothing = repair.repair(df, df.limit(0)).collect()
    assert [tuple(r) for r in nothing] == [(1, 0, 0, 0, 0, 0, 0, "", repair.EMPTY)]
