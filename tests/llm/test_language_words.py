"""Known words are read from the model; only other words take room among the kept ones."""

from __future__ import annotations

import numpy as np

from marlstone.llm import language


class Asked(dict):
    """Counts how often it is asked."""

    times = 0

    def get(self, key, default=None):
        self.times += 1
        return super().get(key, default)


def made(words: int) -> tuple[dict, list[str]]:
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(3)) for i in range(words)]
    rng = np.random.default_rng(5)
    value = lambda n: np.log(rng.random((n, 2), dtype=np.float32))
    grams = [None] + [(Asked({g: i for i, g in enumerate(sorted({f" {w} "[j : j + o] for w in names for j in range(6 - o)}))}), None) for o in range(1, 6)]
    grams = [None] + [(g, value(len(g))) for g, _ in grams[1:]]
    return {"langs": ["aa", "bb"], "prior": np.log([0.5, 0.5]), "words": ({w: i for i, w in enumerate(names)}, value(words)), "grams": grams}, names


def test_known_words_do_not_push_out_others(monkeypatch):
    monkeypatch.setattr(language, "KEPT_WORDS", 50)
    model, names = made(200)
    text = " ".join([*names, *(f"{w}x" for w in names[:20]), names[3], f"{names[3]}x"])
    scorer = language.Scorer(model)
    first = scorer.predict(text)
    asked = sum(g.times for g, _ in model["grams"][1:])
    assert asked > 0
    assert [scorer.predict(text) for _ in range(3)] == [first] * 3
    assert sum(g.times for g, _ in model["grams"][1:]) == asked
    # By plain sums of the vectors of the words, one after another.
    words = language.LETTERS.findall(text)
    total = sum(scorer.vector(w) for w in words)
    p = total[:2] * (20 / len(words)) + model["prior"]
    assert first[0] == model["langs"][int(np.argmax(p))] and abs(first[2] - total[2] / len(words)) < 1e-12
    assert abs(first[1] - 1 / np.exp(p - p.max()).sum()) < 1e-9


def test_model_without_words():
    model, names = made(5)
    model["words"] = ({}, np.zeros((0, 2), dtype=np.float32))
    lang, score, _ = language.Scorer(model).predict(f"{names[0]} {names[1]}q 漢字")
    assert lang in model["langs"] and 0.5 <= score <= 1
