import cProfile
import itertools
import os
import pstats
import random
import tracemalloc

import pyarrow as pa
import pytest

from logfold.llm import pieces as P

sp = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(P.default_model()), reason="no model file")


@pytest.fixture(scope="module")
def codec():
    return P.Codec(P.load(P.default_model()))


@pytest.fixture(scope="module")
def model():
    return sp.SentencePieceProcessor(model_file=P.default_model())


def test_same_ids_as_the_library_and_back(codec, model):
    rng = random.Random(0)
    for k in range(3000):
        text = "".join(rng.choice("abcdefghij  \n\t .éß漢🙂<>thein0") for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            text = text.replace("a", " " * rng.randint(1, 40))
        ids = codec.encode(text).tolist()
        assert ids == model.encode(text) and codec.decode(ids) == text


@pytest.mark.parametrize("text", ["".join(random.Random(1).choice("abcdefthein") for _ in range(20000)), " " * 9000, "a" * 9000, "漢" * 3000, "=" * 5000])
def test_streams_without_boundaries(codec, model, text):
    assert codec.encode(text).tolist() == model.encode(text)


@pytest.mark.parametrize("unit", ["internationalisation", "a", "=", "漢字", "the cat sat ", "x🙂"])
def test_memory_does_not_grow_with_the_stream(codec, unit):
    """Ids are committed while the stream goes on, and the search holds no more after many blocks than after few."""

    def stream(n):
        for _ in range(n):
            yield (unit * (P.BLOCK // len(unit) + 1))[: P.BLOCK]

    def peak(n):
        tracemalloc.start()
        total = sum(map(len, codec.ids(stream(n))))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return total, most

    peak(20)  # the remembered neighbours
    few, many = peak(20), peak(600)
    assert many[0] > 25 * few[0] and many[1] < 2 * few[1] + 100_000


@pytest.mark.parametrize("unit", ["internationalisation", "the cat sat on 17 mats ", "漢字"])
def test_memory_of_encode(codec, unit):
    """Beside the ids themselves, a text of a million characters takes no more than one of a thousandth."""

    def beside(n):
        text = (unit * (n // len(unit) + 1))[:n]
        codec.encode(text)  # the remembered neighbours and stretches
        tracemalloc.start()
        ids = codec.encode(text)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most - 1.2 * ids.nbytes

    assert beside(1_000_000) < beside(1000) + 500_000


def test_remembered_stretches_change_nothing(codec, model, monkeypatch):
    rng = random.Random(4)
    texts = [" " * rng.randint(0, 3) + " ".join("".join(rng.choice("abcthein▁.é") for _ in range(rng.randint(0, 50))) for _ in range(80)) + " " * rng.randint(0, 3) for _ in range(60)]
    want = [model.encode(t) for t in texts]
    for bound in (P.REMEMBERED, 4000):
        monkeypatch.setattr(P, "REMEMBERED", bound)
        assert [codec.encode(t).tolist() for t in texts] == want
    monkeypatch.setattr(P, "REMEMBERED_LENGTH", 0)  # every stretch through the search
    assert [codec.encode(t).tolist() for t in texts] == want


def test_known_stretches_take_no_steps_of_their_own(codec, model):
    """Looking up what is remembered costs calls by the part and not by the stretch, and neighbours cost no merges."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefthein") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    text = " ".join(rng.choice(words) for _ in range(50_000))
    assert codec.encode(text).tolist() == model.encode(text)
    profile = cProfile.Profile()
    profile.runcall(codec.encode, text)
    assert pstats.Stats(profile).total_calls < 5000


def test_boundaries_by_the_merges_of_both_sides(monkeypatch):
    """``fits`` says what merging both pieces together says, for models with equal scores too, and merges each piece once."""
    rng = random.Random(6)
    for _ in range(60):
        some = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
        codec = P.Codec([(p, -float(rng.randint(0, 12)), 1) for p in [*"abc", P.MARK, *sorted(some)]])
        own = [i for p, i in codec.id.items() if codec.merge(p) == [p]]
        want = {(a, b): codec.merge(codec.name[a] + codec.name[b]) == [codec.name[a], codec.name[b]] for a, b in itertools.product(own, own)}
        calls, merge = [], codec.merge
        monkeypatch.setattr(codec, "merge", lambda *a, calls=calls, merge=merge: (calls.append(a), merge(*a))[1])
        assert {pair: codec.fits(*pair) for pair in want} == want and len(calls) == len(own)
        text = "".join(rng.choice("abc ") for _ in range(200))
        assert [codec.name[i] for i in codec.encode(text)] == merge((" " + text).replace(" ", P.MARK))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("together", [1, 700, 1 << 20])
def test_rows_by_parts(codec, model, monkeypatch, kind, together):
    """Rows taken in together give what each gives alone, also from a slice, and long ones by parts."""
    monkeypatch.setattr(P, "TOGETHER", together)
    monkeypatch.setattr(P, "DECODED", together)
    monkeypatch.setattr(P, "PART", 64)
    rng = random.Random(7)
    texts = [None, "", " ", "  ", P.MARK, "a ", " a", "a  ", "\n", "漢🙂 x", "a" * 300, " " * 300, "x" + " " * 200 + "y", "\x00 \x00"]
    texts += ["".join(rng.choice("abcthein   ▁.é漢🙂\n") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    rng.shuffle(texts)
    rows = pa.array(["out", *texts, None], kind).slice(1, len(texts))
    ids = [x for part in codec.encode_rows(rows) for x in part.to_pylist()]
    assert ids == [None if t is None else model.encode(t) for t in texts]
    lists = pa.array([[5], *ids, None], pa.list_(pa.int32())).slice(1, len(ids))
    assert [t for part in codec.decode_rows(lists) for t in part.to_pylist()] == [None if t is None else t.replace(P.MARK, " ") for t in texts]


def test_texts_of_any_ids(codec):
    """Ids that no text has: control pieces, torn and invalid bytes, space marks out of bytes."""
    rng = random.Random(8)
    mark = [codec.byte[b] for b in P.MARK.encode()]
    lists = [[], [0], [1], [2], [1, 300, 400], [codec.byte[32]], [codec.byte[32], 300], [codec.byte[200]], mark, [300, *mark, 301], mark[:2], None]
    lists += [[rng.choice([rng.randrange(300), rng.randrange(len(codec.bytes))]) for _ in range(rng.randint(0, 8))] for _ in range(300)]
    for some in ([x] for x in lists):
        assert next(codec.decode_rows(pa.array(some, pa.list_(pa.int32())))).to_pylist() == [None if x is None else codec.decode(x) for x in some]
    assert [t for part in codec.decode_rows(pa.array(lists, pa.list_(pa.int32()))) for t in part.to_pylist()] == [None if x is None else codec.decode(x) for x in lists]
    with pytest.raises(IndexError):
        next(codec.decode_rows(pa.array([[len(codec.bytes)]], pa.list_(pa.int32()))))


def test_blocks_do_not_matter(codec, model):
    """Any cut of the text into blocks gives the ids of the whole."""
    rng = random.Random(3)
    for _ in range(300):
        text = P.MARK + "".join(rng.choice("abcdefthein ▁.é漢🙂") for _ in range(rng.randint(1, 200))).replace(" ", P.MARK)
        cuts = sorted({0, len(text), *(rng.randint(0, len(text)) for _ in range(rng.randint(0, 30)))})
        some = [i for part in codec.ids(text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)) for i in part]
        assert some == model.encode(text[1:].replace(P.MARK, " "))


def test_long_rows(codec, model):
    for seed in range(3):
        rng = random.Random(seed)
        text = " ".join("".join(rng.choice("abcdefthein") for _ in range(rng.randint(1, 3000))) for _ in range(200))
        assert codec.encode(text).tolist() == model.encode(text) and codec.decode(codec.encode(text)) == text


def test_models_are_told_apart_by_content(spark):
    pieces = P.load(P.default_model())
    other = [(p, s, k) if i != 30001 else (p + "q", s, k) for i, (p, s, k) in enumerate(pieces)]
    share = spark.sparkContext.broadcast
    one, two = P._codec(share((b"1", pieces))), P._codec(share((b"2", other)))
    assert one.id != two.id


def test_rows(spark, odd, odd_rows, empty, model):
    path = P.default_model()
    back = P.decode(P.encode(odd, path), path)
    want = sorted(str((r[0], None if r[1] is None else model.encode(r[1]), None if r[1] is None else r[1].replace("▁", " "))) for r in odd_rows)
    assert sorted(str((r.doc_id, None if r.ids is None else list(r.ids), r.text)) for r in back.collect()) == want
    assert P.encode(empty, path).count() == 0
