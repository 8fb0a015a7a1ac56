import itertools
import random
from collections import Counter

import pytest

from sediment.llm import packing as P


@pytest.mark.parametrize("seed", range(30))
def test_best_filling_is_optimal(seed):
    r = random.Random(seed)
    items = [r.randint(1, 12) for _ in range(r.randint(0, 9))]
    room = r.randint(0, 30)
    best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
    fill = P.best_filling(Counter(items), room)
    assert sum(s * n for s, n in fill) == best
    assert all(n <= Counter(items)[s] for s, n in fill)


@pytest.mark.parametrize("seed", range(10))
def test_fillings_use_every_piece_once_and_leave_the_least_slack(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(1, 50) for _ in range(60))
    left, used = Counter(counts), Counter()
    for fill, times in P.fillings(dict(counts), 50):
        top = max(left)
        for _ in range(times):
            assert sum(s * n for s, n in fill) <= 50 and max(s for s, _ in fill) == top
            used.update(dict(fill))
            left -= Counter(dict(fill))
    assert used == counts and not left


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lot string, N int")


def test_windows(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")  # the same vocabulary for another library
    tok.encode_special_tokens = True
    r = random.Random(1)
    data = [(i, " ".join(["w"] * r.randint(1, 90)), "x", 1) for i in range(300)] + [(7, "a b c", "x", 1)] * 2
    data += [(900, None, None, None), (901, "", "x", 1), (902, " \n ", "x", 1), (None, "z", "x", 1), (903, "w\n" * 1234, "x", 1), (904, "<|endoftext|> é中" + "x" * 30_000, "x", 1)]
    for lot in (20_000, 100):
        out = P.pack(rows(spark, data), capacity=64, lot=lot).collect()
        got, cover = Counter(), Counter()
        for w in out:
            assert w.used == sum(w.lengths) and w.slack == 64 - w.used >= 0
            for d, s, n in zip(w.doc_ids, w.starts, w.lengths, strict=True):
                got[d] += n
                cover.update((d, k) for k in range(s, s + n))
        want = Counter()
        for d, t, *_ in data:
            if t:
                want[d] += len(tok.encode(t, add_special_tokens=False).ids) + 1
        assert got == want
        assert all(v == 1 for (d, _), v in cover.items() if d not in (7,))
        assert len({(w.lot, w.window) for w in out}) == len(out)
        assert sum(w.slack for w in out) <= 64 * (1 if lot > 1000 else 5)


def test_copies_of_a_row_are_spread_over_the_lots(spark):
    d = rows(spark, [(7, "a b c", "x", 1)] * 1000 + [(8, "d", "x", 1)])
    out = P.pack(d, capacity=64, lot=100).collect()
    assert Counter(x for w in out for x in w.doc_ids) == {7: 1000, 8: 1}
    per = Counter()
    for w in out:
        per[w.lot] += len(w.doc_ids)
    assert len(per) == 11 and set(per.values()) <= {90, 91, 92}


def test_empty(spark):
    assert P.pack(rows(spark, []), capacity=8).count() == 0
