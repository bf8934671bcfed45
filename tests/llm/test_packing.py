import random
from collections import defaultdict

from sheafline.llm import packing as K


def brute(sizes, capacity, most):
    """Online best fit by looking at every open container."""
    free, at, opened = {}, [], 0
    for s in sizes:
        fits = [(f, b) for b, f in free.items() if f >= s]
        if fits:
            f, b = min(fits, key=lambda x: x[0])
        else:
            if len(free) >= most:
                del free[min(free, key=free.get)]
            f, b, opened = capacity, opened, opened + 1
        free.pop(b, None)
        if f > s:
            free[b] = f - s
        at.append((b, f))
    return [f for _, f in at], opened


def test_packer_is_best_fit():
    rng = random.Random(1)
    for most in (1, 3, 50):
        sizes = [rng.randrange(0, 100) for _ in range(2000)]
        p = K.Packer(100, most)
        used = defaultdict(int)
        seen = []
        for s in sizes:
            before = dict(used)
            b = p.place(s)
            seen.append(100 - before.get(b, 0))
            used[b] += s
        room, opened = brute(sizes, 100, most)
        assert seen == room and p.opened == opened and max(used.values()) <= 100


def test_containers(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(0, 40), i) for i in range(300)] + [(900, "word " * 500, 0), (901, None, 0), (902, "", 0), (900, "word " * 500, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long")
    limits = spark.createDataFrame([(1, 64), (2, 1000), (3, None), (4, 0)], "limit_id long, capacity_tokens long")
    sizes = {r.doc_id: r.n_tokens for r in K.token_sizes(docs).collect()}
    assert sizes[901] == sizes[902] == 0
    for shard in (50_000, 40):
        out = K.containers(docs, limits, open_bins=8, shard_items=shard).collect()
        for lim, cap in ((1, 64), (2, 1000)):
            used, pieces = defaultdict(int), defaultdict(list)
            for r in out:
                if r.limit_id == lim:
                    used[r.container] += r.tokens
                    pieces[r.doc_id].append((r.start_token, r.tokens))
            assert max(used.values()) <= cap and set(pieces) == set(sizes)
            for d, ps in pieces.items():
                n = 2 if d == 900 else 1
                assert sum(t for _, t in ps) == n * sizes[d]
                assert len(ps) == n * max(1, -(-sizes[d] // cap))
        assert not {3, 4} & {r.limit_id for r in out}
    assert K.containers(docs.limit(0), limits).count() == 0 and K.containers(docs, limits.limit(0)).count() == 0


def test_fill_is_good(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "word " * rng.randrange(1, 60)) for i in range(3000)], "doc_id long, text string")
    limits = spark.createDataFrame([(1, 256)], "limit_id long, capacity_tokens long")
    for shard in (50_000, 500):
        assert K.fill(K.containers(docs, limits, shard_items=shard), limits).first().waste < 0.03
