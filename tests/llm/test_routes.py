"""Training goes only to the shards where it meets something, and no true pair is lost on the way."""

import random

from oodmill.llm import overlap, routes
from tests.llm.test_llm_operators import table, windows


def odd_sequences(rng):
    """Related, rearranged, repetitive and short ones, and some that share a domain only."""
    some = lambda n, letters="ACDEFGHIKLMNPQRSTVWY": "".join(rng.choice(letters) for _ in range(n))
    domain, out = some(40), []
    for _ in range(40):
        s = some(rng.randrange(30, 120))
        at = sorted(rng.sample(range(len(s)), 3))
        a, b, c, d = (s[x:y] for x, y in zip([0, *at], [*at, len(s)], strict=True))
        out += [s, a + c + b + d, s[: len(s) // 2] + some(30), some(20) + s, s[:-3] + "WWW", s + domain]
        out += [some(rng.randrange(5, 12)), some(rng.randrange(8, 60), "AC"), some(rng.randrange(10, 60), "AAAAAAAAAC"), s[: rng.randrange(5, 20)]]
        i = rng.randrange(len(s))
        out.append(s[:i] + "W" + s[i + 1 :])
    return sorted(set(out))


def alike(x, y):
    a, b = windows(x), windows(y)
    return bool(a and b) and len(a & b) >= 0.8 * min(len(a), len(b)) - 1e-9


def sides(spark, seqs):
    ids = lambda own, add: [(i + add, s) for i, s in own]
    rows = list(enumerate(seqs))
    left, right = ids(rows[::2] + rows[1::6], 0), ids(rows[1::2], 1 << 33)
    return left, right, *(table(spark, x, "class_id bigint, seq string") for x in (left, right))


def test_no_pair_is_lost_in_passes_and_buckets(spark):
    left, right, a, b = sides(spark, odd_sequences(random.Random(5)))
    want = {(i, j) for i, s in left for j, t in right if alike(s, t)}
    assert len(want) > 300
    got = [tuple(r) for r in overlap.alike_across(a, b, shard_letters=3000, block_letters=2000).select("train_class", "eval_class").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = overlap.planned_sides(a, b, 5, 0.8)
    for passes in (1, 5):
        assert want <= {tuple(r) for r in routes.routes(plan, 5, passes=passes, bucket_keys=500).collect()}


def test_training_goes_only_to_shards_that_it_meets(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(100)) for _ in range(200)]
    a = table(spark, [(i, s) for i, s in enumerate(seqs[:150])], "class_id bigint, seq string")
    b = table(spark, [(i, s) for i, s in enumerate(seqs[145:], 145)], "class_id bigint, seq string")
    left, right, tasks = overlap.handed_out(overlap.planned_sides(a, b, 5, 0.8), 5, 100, 100)
    assert tasks >= 5
    # every shard met every training sequence before: 150 sequences times all shards
    assert sorted({r["train_class"] for r in left.collect()}) == list(range(145, 150))
    assert left.count() == 5 and {r["eval_class"] for r in right.collect()} == set(range(145, 150))


def test_walks_over_repeated_letters_are_listed():
    # ABCDE, BCDEX from one place and CDEXY, which overlaps, from another
    y = "ABCDEXQQQQCDEXYZ"
    met, begins, walks = routes.plans([y, "ABCDEXY"], 5, 0.8)
    assert len(walks[0]) // 8 >= 1 and len(walks[1]) == 0 and met[1] > 0
