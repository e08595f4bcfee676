"""Language profiles: one order of ties on both sides, and many scripts in little memory."""

import random
import tracemalloc

import pytest

from lakewright.llm import langid

SCHEMA = "doc_id long, lang string, text string"


def scripts(n=12, letters=60, seed=1):
    """Texts of several made-up languages, each of letters of its own."""
    r = random.Random(seed)
    alphabet = [chr(c) for c in range(0x4E00, 0x9000)]
    out = {}
    for k in range(n):
        own = alphabet[k * letters : (k + 1) * letters]
        out[f"l{k:02}"] = " ".join("".join(r.choice(own) for _ in range(r.randint(1, 5))) for _ in range(900))
    return out


def test_own_profile_has_distance_0(spark):
    """Of a text that is its language's only one, ties and letters outside the profile included."""
    r = random.Random(2)
    texts = scripts(4) | {"few": "b a ab", "tie": " ".join(r.sample("the tale of a lathe and its heat ßé Ω".split(), 8)), "rare": "".join(chr(c) + " " for c in range(0x4E00, 0x5000)) + "aa aa"}
    profiles = langid.fit_profiles(spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(texts.items())], SCHEMA))
    model = langid.Profiles(profiles)
    for k, lang in enumerate(model.langs):
        assert model.distances(texts[lang])[0][k] == 0, lang
        assert model.predict(texts[lang]) == (lang, 1.0)


def test_distances_are_those_of_the_definition(spark):
    texts = scripts(5, 20) | {"en": "the tale of the lathe and the heat of the tales", "xx": "la lalà ha e e è"}
    profiles = langid.fit_profiles(spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(texts.items())], SCHEMA))
    model = langid.Profiles(profiles)
    for t in [*texts.values(), "the là Ω ha", "Ωmega ΩΩ", *(" ".join(p[:200].split()[::-1]) for p in texts.values())]:
        counts = langid.grams(t)
        top = sorted(counts, key=lambda g: (-counts[g], len(g), g))[:300]
        want = [sum(abs(i - p.index(g)) if g in p else 300 for i, g in enumerate(top)) for p in (profiles[lang] for lang in model.langs)]
        assert model.distances(t)[0].tolist() == want


def test_many_scripts_in_little_memory(spark):
    texts = scripts()
    profiles = langid.fit_profiles(spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(texts.items())], SCHEMA))
    tracemalloc.start()
    model = langid.Profiles(profiles)
    assert [model.predict(t)[0] for t in texts.values()] == list(texts)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        langid.fit_profiles(spark.range(9).selectExpr("id doc_id", "cast(id as string) lang", "'a' text"))
