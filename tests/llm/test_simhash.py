import random
import re

import xxhash

from contestlab.llm import simhash
from tests.llm.cases import HARD, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """doc_id, fingerprint, component of each row, by all pairs."""
    prints = [brute_fingerprint(t) for _, t in rows]
    comp, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and comp[i] > comp[j]:
                    comp[i], changed = comp[j], True
    ids = [min((d for (d, _), k in zip(rows, comp, strict=True) if k == c and d is not None), default=None) for c in comp]
    return sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, ids, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(30)], []
    for i in range(120):
        base = rows[rng.randrange(len(rows))][1].split() if rows and i % 2 else [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 400]))]
        if len(base) > 50:
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((1000 - i, " ".join(base)))
    got = found(simhash.near_duplicates(documents(spark, [(*r, "en", "s") for r in rows])))
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)} | {f ^ (1 << rng.randrange(64)) for f in list(fps)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and want


def test_hard_rows(spark):
    got = found(simhash.near_duplicates(documents(spark, HARD)))
    assert got == brute_components([r[:2] for r in HARD])
    docs = documents(spark, HARD)
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.keep_one_of_each(docs.limit(0)).count()


def test_rows_without_any_id(spark):
    docs = documents(spark, [(None, "a b", "en", "s"), (None, "a b", "en", "s")])
    assert found(simhash.near_duplicates(docs))[0][2] is None
    assert simhash.keep_one_of_each(docs).count() == 1
