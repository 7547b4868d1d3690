"""Whitening, token counts and alignment against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest

from tidemark.llm.common import Workspace

R = random.Random(11)
ALPHABET = list("abcdeSTé 'sll  \n\t.,!?-|<>09") + [" ", " ", "\x1c", "\x85", "ß", "Σ", "日", "本", "。", "é", "́", "👩‍👩‍👧", "<|endoftext|>", "<|startoftext|>", "it's", "we'll", "▁", "\x00", "ﬁ", "İ", "ก็"]


def odd(n, r=R):
    return "".join(r.choice(ALPHABET) for _ in range(n))


def texts():
    words = ["the", "of", "naïve", "Über", "data", "12", "don't"] + ["".join(R.choice("abcdeghiklmnorstu") for _ in range(R.randint(3, 11))) for _ in range(300)]
    prose = lambda n: " ".join(R.choice(words) for _ in range(n))
    out = [None, "", " ", "\n \n", "a", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "é" * 50, "日本。" * 400, "a" * 5000, "ab, " * 900, "." * 3000, " " * 2000 + "x"]
    out += [odd(R.randint(1, 60)) for _ in range(150)] + [prose(R.randint(1, 300)) for _ in range(40)] + [prose(4000), odd(9000), prose(300).replace(" ", ""), prose(900).replace(" ", "\n")]
    return out + out[20:40]


TEXTS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that the operators use themselves."""
    rows = [(i, t, 1, "q", 2, 3) for i, t in enumerate(TEXTS)] + [(None, "null id here", 1, "q", 2, 3), (3, "an id twice", 1, "q", 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, t string, n int, grp int")


def plain_count(library, t):
    return len(library.encode(t or "", add_special_tokens=False))


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    from tidemark.llm.token_counts import token_counts

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), plain_count(library, r["text"]), plain_count(library, r["text"]) > 40) for r in docs.collect())
    for chunk, margin, overlap in ((32768, 4096, 256), (600, 40, 8), (97, 5, 2)):
        got = Counter(tuple(r) for r in token_counts(docs, Workspace(spark, "t"), path, limit=40, keep=["doc_id"], chunk=chunk, margin=margin, overlap=overlap).collect())
        assert got == want, (chunk, list((got - want).items())[:3], list((want - got).items())[:3])


def test_every_seam_gives_the_whole_count():
    """A document cut in two anywhere: the seam and the rest add up to its tokens."""
    from tidemark.llm.token_counts import counter_of, seam

    c = counter_of(P.path("word_bpe_49k.json"))
    r = random.Random(3)
    for _ in range(150):
        t = odd(r.randint(2, 90), r)
        at = r.randrange(1, len(t)) if len(t) > 1 else 1
        assert seam(c, t, at, True, r.choice((1, 4, 64))) + len(c.spans(t[at:])[0]) == len(c.spans(t)[0]), t
        assert c.count(t) == len(c.spans(t)[0]), t


def test_other_tokenizer_files_are_refused():
    from tidemark.llm.token_counts import Counter as Words

    with pytest.raises(ValueError):
        Words(P.path("byte_bpe_50k.json"))


def plain_alignment(rows):
    """The contract, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    from tidemark.llm.token_alignment import byte_symbols

    a, b, symbols = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte_symbols()
    a.encode_special_tokens = True
    out, links_of, count = [], [], Counter()
    for i, t in rows:
        x, y, links, groups = [], [], [], []
        if t:
            x = a.encode(" " + t, add_special_tokens=False).ids
            y = b.encode(t)
            said_x = [bytes(symbols[c] for c in a.id_to_token(k)) for k in x]
            said_y = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
            if b"".join(said_x) != (" " + t).encode() or b"".join(said_y) != (" " + t).encode():
                x, y = [], []
            else:
                ends_x, ends_y = np.cumsum(list(map(len, said_x))).tolist(), np.cumsum(list(map(len, said_y))).tolist()
                for p, (e, w) in enumerate(zip(ends_x, said_x)):
                    for q, (f, v) in enumerate(zip(ends_y, said_y)):
                        if e - len(w) < f and f - len(v) < e:
                            links.append((x[p], y[q]))
                at = 0
                for e in sorted(set(ends_x) & set(ends_y)):
                    groups.append(",".join(str(k) for k, z in zip(x, ends_x) if at < z <= e) + "|" + ",".join(str(k) for k, z in zip(y, ends_y) if at < z <= e))
                    at = e
        count.update(links)
        links_of.append(links)
        out.append([i, len(x), len(y), len(groups), len(links), ";".join(groups)])
    best = {}
    for (_, q), n in count.items():
        best[q] = max(best.get(q, 0), n)
    return Counter((i, x, y, g, n, sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(s.encode()).hexdigest() if s else "") for (i, x, y, g, n, s), links in zip(out, links_of))


def test_alignment_equals_the_plain_version(spark, docs, monkeypatch):
    from tidemark.llm import token_alignment as T

    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 3500]
    want = plain_alignment(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for few in (False, True):
        if few:  # groups, slices and lanes of a few tokens, also in the workers
            monkeypatch.setattr(T, "SLICE", 900)
            monkeypatch.setattr(T, "GROUP", 2000)
        got = Counter(tuple(r) for r in T.align(d, Workspace(spark, "t"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), keep=["doc_id"]).collect())
        assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])


def test_lanes_and_blocks_change_nothing(monkeypatch):
    from tidemark.llm import token_alignment as T

    two = T.models(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    some = [t for t in TEXTS if t][:120] + [" ".join(odd(40) for _ in range(60))]
    want = T.align_slice(some, two, T.Pairs())
    monkeypatch.setattr(T, "BLOCK", 50)
    monkeypatch.setattr(T, "REACH", 5)
    lanes = T.lanes
    monkeypatch.setattr(T, "lanes", lambda a, b, d: lanes(a, b, d, 7))
    got = T.align_slice(some, two, T.Pairs())
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        assert (got[c] == want[c]).all()
    assert got["groups_sha256"] == want["groups_sha256"] and [sorted(T.unplanes(x).tolist()) for x in got["counts"]] == [sorted(T.unplanes(x).tolist()) for x in want["counts"]]


def test_words_of_settled_characters_equal_the_library():
    """All characters that the quick encoder takes, in the surroundings in which classes matter."""
    from tidemark.llm import token_alignment as T

    two = T.models(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert two.quick
    parts = [f"{a}{chr(c)}{b}" for c in range(T.SETTLED) for a, b in (("", ""), (" a", "b"), (" 1", "2"), (" ", "."), ("  ", " \n"), (" '", "s"), (".", "'"))]
    assert [two.quick._core_bpe.encode_ordinary(p) for p in parts] == [e.ids for e in two.a.encode_batch_fast(parts, add_special_tokens=False)]


def vectors(r, n=60, dim=5):
    out = [[r.gauss(0, 1) * (k + 1) + (k == 2) * 3 for k in range(dim)] for _ in range(n)]
    return out + out[:7]


def plain_whitening(rows):
    """By fractions and a dense eigen-decomposition."""
    xs = [(i, [int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in xs})
    n, dim = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(dim)]
    mean = [Fraction(v, n) for v in s]
    v = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(dim)] for i in range(dim)])
    e, axes = np.linalg.eigh(v)
    return n, {(i, tuple(x)): sum((n * x[k] - s[k]) ** 2 for k in range(dim)) for i, x in xs}, e[::-1], axes[:, ::-1], np.trace(v), [float(m) for m in mean], xs


def test_whitening_equals_fractions(spark):
    from tidemark.llm.whitening import whiten

    r = random.Random(8)
    rows = list(enumerate(vectors(r)))
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, [])]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<float>, x string, n int").repartition(5)
    n, deviation, e, axes, trace, mean, xs = plain_whitening([(i, np.array(v, np.float32).tolist()) for i, v in rows])
    got = {(q["vec_id"], q["component"]): q for q in whiten(d, Workspace(spark, "t"), components=4, keep=["vec_id"]).collect()}
    assert len(got) == len(rows) * 4 and {i for i, _ in got} == {i for i, _ in rows}
    for k in range(4):
        signs = set()
        for i, x in xs:
            q = got[i, k + 1]
            want = float((np.array(x) - mean) @ axes[:, k] / np.sqrt(e[k]))
            assert q["n"] == n and q["deviation"] == deviation[i, tuple(x)]
            assert abs(abs(q["whitened"]) - abs(want)) < 1e-9 and abs(q["explained"] / (e[k] / trace) - 1) < 1e-9 and q["identity_error"] < 1e-9
            signs.add(np.sign(q["whitened"] * want))
        assert len(signs - {0.0}) == 1


def test_whitening_edges(spark):
    from tidemark.llm.whitening import exact_sums, whiten

    kind = "vec_id long, embedding array<double>"
    work = lambda: Workspace(spark, "t")
    assert whiten(spark.createDataFrame([], kind), work(), keep=["vec_id"]).count() == 0
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], kind), work(), keep=["vec_id"]).collect()
    assert len(one) == 4 and all(q["whitened"] is None and q["explained"] == 0 and q["deviation"] == 0 and q["n"] == 1 and q["identity_error"] is None for q in one)
    two = whiten(spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [1.0, 5.0]), (4, [2.0, 7.0]), (5, [4.0, 0.0])], kind), work(), keep=["vec_id"]).collect()
    assert sorted((q["vec_id"], q["component"]) for q in two) == [(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2)] and {q["vec_id"]: q["n"] for q in two} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}
    huge = whiten(spark.createDataFrame([(1, [1e300]), (2, [-3e9]), (3, [0.0])], kind), work(), keep=["vec_id"]).collect()
    assert len(huge) == 3 and all(q["identity_error"] < 1e-9 for q in huge)
    x = [[(1 << 60) + k, -k * k] for k in range(50)]
    fit = spark.createDataFrame([(v,) for v in x], "x array<long>")
    n, sums = exact_sums(fit, {2: [3, -5]})[2]
    assert n == 50 and sums[0, 1] == sum((p - 3 + q + 5) ** 2 for p, q in x) and sums[0, 0] == sum((p - 3) ** 2 for p, _ in x)


def test_empty_tables(spark):
    from tidemark.llm.token_alignment import align
    from tidemark.llm.token_counts import token_counts

    d = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(d, Workspace(spark, "t"), P.path("word_bpe_49k.json"), keep=["doc_id"]).count() == 0
    assert align(d, Workspace(spark, "t"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), keep=["doc_id"]).count() == 0
