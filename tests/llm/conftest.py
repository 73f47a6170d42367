import random

import pytest

SYLLABLES = {"en": "the and ing er on at st re nd th ou".split(), "fr": "eau é que le ment oi aux tion ai è".split(), "de": "sch en ung ü keit ein ß ver ö lich".split()}


class Prose:
    """Invented prose of a language, from a seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, lang: str = "en") -> str:
        return "".join(self.r.choice(SYLLABLES[lang]) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int, lang: str = "en") -> list[str]:
        return [self.word(lang) for _ in range(n)]

    def text(self, n: int, lang: str = "en") -> str:
        out = []
        for i, w in enumerate(self.words(n, lang)):
            out.append(w.capitalize() if i % 9 == 0 else w)
            out.append(".\n" if i % 9 == 8 and i % 4 == 0 else ". " if i % 9 == 8 else " ")
        return "".join(out).strip()


@pytest.fixture
def prose():
    return Prose(7)


@pytest.fixture
def docs_of(spark):
    """(doc_id, text) rows, spread over partitions, with extra columns of clashing names."""

    def make(rows, **more):
        schema = "doc_id long, text string, " + ", ".join(["lang string", "source string", "n_chars long", "doc string", "id int", "a int", "entry string", "size string", "n int"])
        full = [(i, t, *(more[c](i) if c in more else None for c in ("lang", "source", "n_chars")), "x", 1, 2, "e", "s", 3) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return make
