"""Operators 5, 6, 9 and 10."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewright.llm import jaccard_join
from tidewright.llm.chat_windows import read_back, windows
from tidewright.llm.components import components
from tidewright.llm.jaccard_join import JaccardJoin, Tree, coarse_bits, dense, fine_bits, fine_bound, groups_of, least_overlap, occupied, overlap_bound, point
from tidewright.llm.language_id import Parser, automaton, language_id
from tidewright.llm.mixing import select_documents
from tidewright.llm.shingles import WordHashes, shingle_set

# -- 9 ----------------------------------------------------------------------------------------------------------------------------


def near_copies(seed, families=8, copies=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(50))
    out = []
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 150]))]
        for c in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy) + (" " + passage if (f + c) % 3 == 0 else ""))
    return out


def brute_components(rows):
    known = WordHashes()
    sets = [set(shingle_set(t, known).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(((doc, len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)), key=str)


ODD_TEXTS = ["", None, " \n\t ", "one two", "ONE  two", "one two three", "a b c d e", "A B C D E", "é É", "x " * 5000]


@pytest.mark.parametrize(("block", "candidates", "factor"), [(4096, 4, 8), (3, 4, 8), (3, 1, 2)])  # 3: buckets go block by block; 1: many rounds
def test_join_finds_all_groups(spark, monkeypatch, block, candidates, factor):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "CANDIDATES", candidates)
    monkeypatch.setattr(jaccard_join, "FACTOR", factor)
    texts = near_copies(4) + ODD_TEXTS
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, "alone here without any id at all")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, cls string").repartition(3)
    found = JaccardJoin(docs).groups()
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_components(rows)


def test_names_that_two_sets_share(spark, monkeypatch):
    """With names of three bits every name is shared; the other half tells sets apart."""
    whole = jaccard_join.set_digest

    def short(shingles):
        return whole(shingles)[0] % 8, whole(shingles)[1]

    # workers import the module as it is, so both of its functions that name sets are sent along
    monkeypatch.setattr(jaccard_join, "set_digest", short)
    monkeypatch.setattr(jaccard_join, "name_of", lambda s, shared: short(s)[1] if short(s)[0] in shared else short(s)[0])
    rows = [(i * 3, t) for i, t in enumerate(near_copies(6, 3, 5))]
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(join.shared) > 3
    assert sorted(map(tuple, join.groups().collect()), key=str) == brute_components(rows)


def test_join_of_nothing(spark):
    assert JaccardJoin(spark.createDataFrame([], "doc_id long, text string")).groups().count() == 0


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 400, 3000, 70_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rng.integers(0, 2**63, n // 20 + 1, dtype=np.uint64)]))
        (p, q), shared = map(point, (a, b)), len(np.intersect1d(a, b))
        for x, raw in ((a, p), (b, q)):
            assert (groups_of([raw])[0] == (x >> np.uint64(64 - fine_bits(len(x))))).all()
        bits = min(fine_bits(len(a)), fine_bits(len(b)))
        assert shared <= fine_bound(occupied(p, len(a), bits), [q, q], fine_bits(len(b)))[1] <= shared + 1 + n // 100
        groups = min(coarse_bits(len(a)), coarse_bits(len(b)))
        assert overlap_bound(*(dense([raw], np.array([len(x)]), groups)[0] for x, raw in ((a, p), (b, q)))) >= shared
    points, sizes = rng.integers(0, 4, (100, 64)), np.sort(rng.integers(60, 160, 100))
    for i in range(0, 100, 7):
        fits = (4 * np.minimum(sizes, sizes[i]) >= 3 * np.maximum(sizes, sizes[i])) & (np.minimum(points, points[i]).sum(1) >= least_overlap(sizes[i], sizes))
        assert set(np.flatnonzero(fits)) <= set(Tree(points, sizes).partners(points[i], int(sizes[i])))


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    expect = {x: find(x) for u, v in links if u != v for x in (u, v)}
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == expect
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 10 ---------------------------------------------------------------------------------------------------------------------------


def greedy_phrases(text, reference):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(8)
    samples = {name: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(150)) for name, letters in (("aa", "abcde"), ("bb", "defgh"))}
    parser = Parser(samples)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(30)) for _ in range(6)]
    found = parser.phrases([parser.symbols(t) for t in texts])
    for t, row in zip(texts, found, strict=True):
        own = bytes(parser.symbols(t))
        for name, n in zip(parser.names, row, strict=True):
            stretches = [own[i : i + 256] for i in range(0, len(own), 256)]
            assert n == sum(greedy_phrases(s, bytes(parser.symbols(samples[name]))) for s in stretches)


def test_letters_of_large_scripts():
    """Two languages of 900 Han letters each, of which most are common to both, and 5000 letters: no letter stands for another."""
    rng = random.Random(14)
    both, own = [chr(0x4E00 + i) for i in range(700)], {"a": [chr(0x5E00 + i) for i in range(200)], "b": [chr(0x6E00 + i) for i in range(200)]}

    def text(lang, n):
        return "".join(rng.choice(own[lang] if rng.random() < 0.2 else both) for _ in range(n))

    parser = Parser({lang: text(lang, 6000) for lang in own})
    assert parser.width <= 2 + 62 + 64
    found = parser.predict([text(lang, 80) for lang in "ab" * 20])[0]
    assert sum(a == b for a, b in zip(found, "ab" * 20, strict=True)) >= 38
    many = "".join(chr(0x4E00 + i) for i in range(5000))
    parser = Parser({"zh": many, "en": "abc abd"})
    whole = parser.symbols(many)
    assert len({bytes(whole[i : i + 3]) for i in range(1, len(whole) - 1, 3)} | {bytes(parser.symbols(x)) for x in "abd"}) >= 4940
    assert list(parser.symbols("ж")) == [0, 1, 0]  # in no sample


def test_hundreds_of_languages(spark):
    """None is left out, and ties go by name."""
    rows = [(i * 10 + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + j)}" for j in range(8)), f"l{i:03}", "") for i in range(300) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = language_id(docs).collect()
    assert len({r.lang_pred for r in found}) == 300
    truth = {r[0]: r[2] for r in rows}
    assert sum(truth[r.doc_id] == r.lang_pred for r in found) > 0.98 * len(rows)
    parser = Parser({"b": "same text", "a": "same text"})
    assert parser.predict(["same text"])[0] == ["a"]


def test_automaton_knows_all_substrings():
    symbols = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    table = automaton(symbols, 4)
    for i in range(len(symbols)):
        state = 1
        for c in symbols[i:]:
            state = table[state, c]
            assert state
    assert not table[table[1, 3], 3]


def test_language_id(spark):
    rng = random.Random(9)
    words = {"en": "the of and house water this that with from".split(), "de": "der und das nicht wasser haus mit von schön".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang if i % 9 else None, "x") for i, lang in ((i, ("en", "de")[i % 2]) for i in range(200))]
    rows += [(900, None, "en", "x"), (901, "", "en", "x"), (902, "12 34 !?", "de", "x"), (None, "the house and the water", None, "x"), (903, "DAS HAUS UND " * 4000, None, "x"), (3, rows[3][1], "de", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    found = {(r.doc_id, r.lang_pred): r for r in language_id(docs).collect()}
    assert len(found) == 205
    truth = {i: ("en", "de")[i % 2] for i in range(200)}
    assert all((i, lang) in found for i, lang in truth.items())
    for doc, name in ((900, "und"), (901, "und"), (902, "und"), (None, "en"), (903, "de")):
        assert (doc, name) in found
    assert all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for (i, _), r in found.items())
    # what is held out has no say
    other = [(i, "zz zz" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else t, lang, x) for i, t, lang, x in rows]
    again = {(r.doc_id, r.lang_pred): r for r in language_id(spark.createDataFrame(other, docs.schema)).collect()}
    assert all(again[k].bits == r.bits for k, r in found.items() if not r.held_out)
    assert language_id(spark.createDataFrame([], docs.schema)).count() == 0


# -- 5 ----------------------------------------------------------------------------------------------------------------------------


def brute_mixture(rows, weights, share, epochs, seed):
    tokens = {}
    for d, text, lang, source in rows:
        number = "".join(c for c in (source or "") if c.isdigit())
        key = (f"domain{int(number) // 5}" if number else "", lang or "", source or "")
        tokens.setdefault(key, []).append((d, len((text or "").split())))
    held = {k: sum(n for _, n in v) for k, v in tokens.items()}

    def divide(children, budget):
        out, left = {}, dict(children)
        while left:
            level = budget / sum(w for w, _ in left.values())
            full = [k for k, (w, room) in left.items() if room <= w * level * (1 + 1e-12)]
            if not full:
                return out | {k: w * level for k, (w, _) in left.items()}
            for k in full:
                out[k] = left.pop(k)[1]
                budget -= out[k]
        return out

    def down(prefix, budget, depth):
        name = ["domain", "language", "source"][depth]
        rooms = {}
        for k, n in held.items():
            if k[:depth] == prefix and n:
                rooms[k[depth]] = rooms.get(k[depth], 0) + n * epochs
        shares = divide({k: (weights.get(name, {}).get(k, 1.0), room) for k, room in rooms.items()}, budget)
        return {prefix + (k,): b for k, b in shares.items()} if depth == 2 else {x: b for k, s in shares.items() for x, b in down(prefix + (k,), s, depth + 1).items()}

    out = {}
    for leaf, budget in down((), float(int(sum(held.values()) * share)), 0).items():
        whole, rest = divmod(int(budget + 1e-6), held[leaf])
        order = sorted((hashlib.md5(f"{seed}:{whole}:{d if d is not None else ''}".encode()).hexdigest(), n, d) for d, n in tokens[leaf])
        for key, _, d in order:
            times = whole + (sum(n for k, n, _ in order if k <= key) <= rest)
            if times:
                out[d] = times
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.9, 1), (1.4, 3)])
def test_mixture(spark, share, epochs):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["en", "en", "de", None]), rng.choice(["src0", "src0", "src1", "src7", "src12", None])) for i in range(300)]
    weights = {"domain": {"domain0": 3.0, "domain1": 5.0}, "language": {"en": 4.0}, "source": {"src1": 2.5}}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = select_documents(docs, weights, share, epochs, 5)
    assert {r.doc_id: r.times_ for r in found.collect()} == brute_mixture(rows, weights, share, epochs, 5)
    assert found.columns[:4] == docs.columns


def test_mixture_of_nothing_and_of_repeats(spark):
    schema = "doc_id long, text string, lang string, source string, tokens string, key string"
    assert select_documents(spark.createDataFrame([], schema), {}, 0.5, 1, 1).count() == 0
    rows = [(1, "a b", "en", "src1", "", "")] * 3 + [(2, None, "en", "src1", "", ""), (None, "x", "en", "odd", "", "")]
    assert select_documents(spark.createDataFrame(rows, schema), {}, 1.0, 1, 1).count() == 5


# -- 6 ----------------------------------------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "one two three " * 30), (1, 2, "assistant", "four <|im_end|> five " * 25), (1, 3, "user", "six"), (1, 4, "assistant", "seven\\n<\\|im_start|>"),
    (2, 0, "user", "<|im_end|><|im_start|>assistant ok"), (2, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (3, None, "assistant", None), (3, 1, None, "x"), (3, 1, "ro\nle<\\/>", "\\\\ <\\\\| é🎉"),
    (None, 0, "user", ""), (4, 0, "assistant", "dup"), (4, 0, "assistant", "dup"), (5, 0, "assistant", "long " * 2000), (5, 1, "assistant", "short"), (6, 0, "system", "only"), (7, 0, "user", "<"), (7, 1, "assistant", "|im_start|>"),
]


@pytest.mark.parametrize(("budget", "history"), [(100, 100), (1, 1), (10_000, 100), (64, 64)])
def test_windows_read_back(spark, budget, history):
    turns = spark.createDataFrame([(*t, "clash", "clash") for t in TURNS], "conv_id long, turn long, role string, text string, window string, size string")
    made = windows(turns, budget, history)
    back = {r.conv_id: r for r in read_back(made).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert [(x.role, x.text) for x in back[conv].turns] == [t[1:] for t in own]
        assert back[conv].targets == "".join(t[2] for t in own if t[1] == "assistant")
    for w in made.collect():
        assert w.formatted.count("<|im_start|>") == w.formatted.count("<|im_end|>\n") > w.n_repeated
        for s in w.loss:
            assert w.formatted[: s.start].rpartition("<|im_start|>")[2] == "assistant\n" and w.formatted[s.start + s.length :].startswith("<|im_end|>\n")
        if w.conv_id == 1:
            assert w.formatted.startswith("<|im_start|>system\nBe kind.<|im_end|>\n")
    if budget == 100:
        assert any(w.n_repeated > 1 for w in made.collect()) and back[1].formatted_chars > sum(len(t[3]) for t in TURNS if t[0] == 1)
    assert windows(spark.createDataFrame([], turns.schema)).count() == 0


@pytest.mark.parametrize(("budget", "history"), [(256, 64), (60, 20)])
def test_windows_keep_to_the_budget(spark, budget, history):
    """Unless one turn and the system turn together are larger, and then nothing else is repeated with them."""
    rng = random.Random(3)
    turns = [(c, t, ("system" if t == 0 and c % 2 else "user" if t % 2 else "assistant"), "w " * rng.choice([0, 1, 3, 10, 18, 25])) for c in range(12) for t in range(30)]
    turns += [(50, 0, "user", "w " * 100), (50, 1, "assistant", "w " * 250), (50, 2, "user", "w " * 250)]
    for c, (first, *sizes_of) in ((60, ("system", 196, 48, 48, 48)), (61, ("user", 38, 18, 218, 8)), (62, ("system", 58, 48, 178, 98)), (63, ("system", 300, 5, 5)), (64, ("system", 3, 3, 400, 3, 3))):
        turns += [(c, i, first if i == 0 else "user" if i % 2 else "assistant", "w " * n) for i, n in enumerate(sizes_of)]
    made = windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget, history).collect()

    def sizes(w):
        return [len(part.partition("\n")[2].removesuffix("<|im_end|>\n").split()) + 2 for part in w.formatted.split("<|im_start|>")[1:]]

    for w in made:
        own = sizes(w)[w.n_repeated :]
        lead = sizes(w)[0] if w.n_repeated and w.formatted.startswith("<|im_start|>system") else 0
        assert sum(sizes(w)) <= budget or (len(own) == 1 and own[0] + lead > budget and w.n_repeated == (lead > 0)), (w, sizes(w))
    assert sum(len(sizes(w)) > 1 for w in made) > len(made) / 2
