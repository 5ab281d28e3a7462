"""Document and corpus decide before the prior; odd long texts take linear time."""

import time

import pytest

from threadloom.llm import sentences as S


@pytest.fixture
def no_prior(monkeypatch):
    nothing = S.Prior("", "", "", "", "", "")
    monkeypatch.setattr(S, "CORE_PRIOR", nothing)
    monkeypatch.setattr(S, "WIDE_PRIOR", nothing)


NAMES = ["Arrowen", "Bexwick", "Lundeby", "Ostrand"]


def made_texts():
    """``Zqr.`` stands before names, ``xlp.`` before numbers, ``wvk.`` goes on in lower case; ``late`` only ends sentences."""
    out = []
    for k in range(24):
        a, b = NAMES[k % 4], NAMES[(k + 1) % 4]
        out.append(f"We asked Zqr. {a} about the plan on xlp. {k + 3} today, as it was. The plan of {a} came late. It was wvk. fine when we saw {b} so late. We know Zqr. {b} from xlp. {k + 4} of the list.")
    return out


def test_corpus_teaches_unknown_abbreviations(spark, no_prior):
    texts = made_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.token: r.bits for r in S.corpus_decisions(df).collect()}
    assert kinds["zqr"] & S.BEFORE_CAPITAL and kinds["xlp"] & S.BEFORE_DIGIT and kinds["wvk"] & S.BEFORE_LOWER and not kinds.get("late", 0) & S.BEFORE_CAPITAL
    got = {}
    for r in S.sentence_ends(df).collect():
        got.setdefault(r.doc_id, []).append(r.end_offset)
    for k, text in enumerate(texts):
        want = [text.index("it was. ") + 7, text.index("late. It") + 5, text.index("late. We") + 5, len(text)]
        assert sorted(got[k]) == want
    assert len(S.Segmenter({}).ends(texts[0])) > 4  # without the corpus none of these is known


def test_document_teaches_before_the_prior(no_prior):
    text = "We met in bldx. two today. Then we moved to bldx. three again. All of us saw bldx. four. It was late. We left."
    assert S.Segmenter({}).ends(text) == [26, 62, 88, 101, len(text)]


@pytest.mark.parametrize("text", ["(" * 40000 + ")" * 40000, "([{«" * 20000, "ab.cd." * 20000, "Ab.Cd." * 14000, '"a." ' * 20000, "1. " * 40000, "a. " * 40000])
def test_long_odd_texts_take_linear_time(text):
    began = time.time()
    S.Segmenter({}).ends(text)
    S.word_evidence([text])
    assert time.time() - began < 5


def test_long_words_are_counted_like_others():
    word = "Donaudampfschifffahrtsgesellschaft"
    rows = S.word_evidence([f"Die {word} und die {word.lower()} waren da. Also kam die {word} an."])
    assert rows[word.lower()][:3] == [3, 1, 2]


def test_first_members_far_and_near_agree(spark):
    df = spark.createDataFrame(list(enumerate(made_texts())), "doc_id long, text string")
    near, far = (sorted(map(tuple, S.sentence_ends(df, broadcast_rows=n).collect())) for n in (S.DECISIONS_BROADCAST, 0))
    assert near == far
