"""The tree over a cell's register rows: the best row of every site by brute force, and how many rows a search looks at."""

import random

import numpy as np
import pyarrow as pa
import pytest

from careflow.operators import match as MT
from test_match import _tsr

SITES = pa.schema([("lnt", pa.list_(pa.string())), ("la", pa.string()), ("lat", pa.list_(pa.string()))])
REGISTER = pa.schema([("rid", pa.string()), ("rname", pa.string()), ("ord", pa.int64()), ("rnt", pa.list_(pa.string())), ("rat", pa.list_(pa.string())), ("rc", pa.string())])


def _once(text):
    return list(dict.fromkeys(text.split()))


def _site(name, address):
    return {"lnt": _once(name), "la": address, "lat": _once(address)}


def _row(i, name, address, city):
    return {"rid": f"f{i}", "rname": name, "ord": i, "rnt": _once(name), "rat": _once(address), "rc": city}


def _best(sites, rows):
    found = MT.best_in_cell(pa.Table.from_pylist(sites, schema=SITES), pa.Table.from_pylist(rows, schema=REGISTER))
    return {i: (round(score, 9), row["ord"]) for i, score, row in found}


@pytest.mark.parametrize("letters", ["ab", "0123456789", "abcdefghijklmnopqrstuvwxyz"])
def test_best_row_equals_brute_force(letters):
    r = random.Random(letters)
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(40)]
    text = lambda most: " ".join(r.choice(words) for _ in range(r.randint(0, most)))
    sites = [_site(text(4), text(5)) for _ in range(12)]
    rows = [_row(i, text(4), text(6), r.choice([None, "", *words[:4]])) for i in range(700)]
    expected = {}
    for i, s in enumerate(sites):
        scores = [MT._sum(_tsr(" ".join(s["lnt"]), " ".join(x["rnt"])), _tsr(" ".join(s["lat"]), " ".join(x["rat"])), 100.0 if x["rc"] is not None and x["rc"] in s["la"] else 0.0) for x in rows]
        expected[i] = round(max(scores), 9), next(k for k, score in enumerate(scores) if score >= max(scores) - 1e-9)
    assert _best(sites, rows) == expected


def test_work_of_a_site_follows_the_rows_near_its_best(monkeypatch):
    looked, whole = [], MT._Side.rows
    monkeypatch.setattr(MT._Side, "rows", lambda self, js: looked.append(len(js)) or whole(self, js))
    r = random.Random(7)

    def share(many):
        rows = []
        for k in range(many):
            city = r.randrange(25)
            rows.append(_row(k, f"supplier {k:09d}", f"{100 + k % 900} rue asia nation {city} h{city % 10}x", f"nation {city}"))
        sites = [_site(f"supplier {u:09d}", f"{100 + u % 900} nation {u % 25}") for u in r.sample(range(many), 40)]
        looked.clear()
        _best(sites, rows)
        return sum(looked) / 2 / len(sites)  # both fields are counted

    small, large = share(5_000), share(40_000)
    assert large < 0.05 * 40_000 and large < 7 * small  # the register grew eightfold


def test_long_and_empty_fields():
    rows = [_row(0, "", "", None), _row(1, "a" * 70_000, "b", ""), _row(2, "x y", "1 rue", "rue")]
    assert _best([_site("", ""), _site("a" * 70_000, ""), _site("y x", "rue 1")], rows) == {0: (15.0, 1), 1: (70.0, 1), 2: (100.0, 2)}
    assert MT._Tokens(pa.chunked_array([[["a" * 70_000]]])).letters[0, 0] == 70_000 and np.iinfo(MT._Tokens(pa.chunked_array([[["ab"]]])).letters.dtype).max == 255
