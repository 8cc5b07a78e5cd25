"""Text folding: literal strings with their normalized forms written out."""

import random
import re
import unicodedata

import pytest

from careflow.functions import lexicon as L
from careflow.functions.text import normalize_identifier, normalize_main, normalize_scored

SCORED = [
    ("bệnh", "benh"), ("ﬁevre", "fievre"), ("37² ½", "372 12"), ("１２ ｈｏｕｒｓ", "12 hours"), ("fièvre", "fievre"), ("Fièvre", "fievre"),
    ("FIÈVRE forte", "fievre forte"), ("𝐇ello Ⅻ", "hello xii"), ("№ 5", "no 5"), ("œuvre", "uvre"), ("日本 a", "a"), ("été", "ete"), ("K", "k"), (None, ""), ("", ""),
]
MAIN = [
    ("fièvre", "fievre"), ("Hôpital Œuvre-Saint", "hopital oeuvre saint"), ("ﬁèvre", "fievre"), ("bệnh", "benh"), ("１２ ｈｏｕｒｓ", "12 hours"),
    ("Ødegård Łódź Straße Þór Æsir đ", "odegard lodz strasse thor aesir d"), ("café noir", "cafe noir"), ("ŒUVRE ß", "oeuvre ss"), (None, ""),
]


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["n"] for r in df.select("i", fn("t").alias("n")).orderBy("i").collect()]


@pytest.mark.parametrize("fn,cases", [(normalize_scored, SCORED), (normalize_main, MAIN)])
def test_literal_forms(spark, fn, cases):
    assert _apply(spark, fn, [a for a, _ in cases]) == [b for _, b in cases]


def test_identifier(spark):
    assert _apply(spark, normalize_identifier, ["CHU Saint-Éloi (Montréal)", "École"]) == ["chu_saint_eloi_montreal", "ecole"]


def _plain_scored(text):
    folded = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return " ".join(re.sub("[^a-z0-9]+", " ", folded).split())


def _plain_main(text):
    text = text.translate({ord(x): y for a, b in L.TRANSLIT_EXTRA for x, y in ((a, b), (a.upper(), b)) if len(x) == 1})
    # of a compatibility character the ASCII part counts; a letter that stands for itself alone is a gap
    text = "".join(a if (a := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) else c for c in text)
    text = "".join(c for c in text if not unicodedata.category(c).startswith("M")).lower()
    return " ".join(re.sub("[^a-z0-9]+", " ", text).split())


def test_random_strings_fold_like_the_plain_form(spark):
    rnd = random.Random(6)
    letters = [*L.FOLD, *L.FOLD_SEVERAL, *"abcXYZ 019.-\t\n" * 60, *"日本ж́̈ßæœøđðłþŒÆØÞ€‍" * 20]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    assert _apply(spark, normalize_scored, texts) == [_plain_scored(t) for t in texts]
    safe = [t for t in texts if not set(t) & set("ẞ")]  # capital sharp s has no capital form of its own
    assert _apply(spark, normalize_main, safe) == [_plain_main(t) for t in safe]
