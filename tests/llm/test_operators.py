"""Each training-data operator against a plain version on small tables, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from gridmason.llm import chat, ctw, hash_forest, mixing, pieces, quality, ring, simhash, token_store, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, block long, fp string, `__row` string"
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there".split()


def made(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(r.randint(1, 80)))
        rows.append([i, text, r.choice(["en", "de"]), f"s{min(r.randint(0, 5), 3)}"])
    rows += [[n, None, None, None], [n + 1, "", "en", "s0"], [n + 2, "  \n\t ", "en", "s0"], [n + 3, rows[0][1], "en", "s1"], [n + 4, "word " * 30_000, "en", "s2"], [None, "a text without an id", "en", None], list(rows[1]), list(rows[1])]
    return [tuple(x) + (1, 2, "k", 3, "f", "r") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(120), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


# --- 1 -------------------------------------------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long")


def test_nearest_small_is_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4)], 0, 0) for i in range(150)]
    rows += [(200, None, 0, 0), (220, [], 0, 0), (240, [0.0] * 4, 0, 0), (260, [1.0, None, 1.0, 1.0], 0, 0), (280, [float("nan")] * 4, 0, 0), (300, [float("inf")] * 4, 0, 0), rows[0], (320, [1.0, 2.0], 0, 0)]
    good = {i: v for i, v, *_ in rows if v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    got = collections.defaultdict(list)
    for x in hash_forest.nearest(vectors(spark, rows), lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    for q in good:
        if q % 20 == 0:
            order = sorted((-float(np.dot(np.float64(good[q]), np.float64(v))), i) for i, v in good.items() if i != q)[:20]
            assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert set(got) == {q for q in good if q % 20 == 0}


def test_nearest_equal_vectors(spark):
    rows = [(i, [1.0, 0.0], 0, 0) for i in range(70)] + [(100, [0.5, 0.1], 0, 0)]
    got = hash_forest.nearest(vectors(spark, rows), lambda i: i % 20 == 0).where("query_id = 20").orderBy("rank").collect()
    assert [x.vec_id for x in got] == list(range(20))
    assert hash_forest.nearest(vectors(spark, []), lambda i: i % 20 == 0).count() == 0


def test_forest_recall():
    r = np.random.default_rng(2)
    x = r.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = hash_forest.Forest(x)
    hit = n = 0
    for q, found in zip(x[:60], forest.candidates(x[:60], int(hash_forest.SHARE * len(x)))):
        best = np.argsort(-(x @ q))[:21]
        hit += len(np.intersect1d(best, found))
        n += len(best)
        assert len(found) < 0.8 * len(x)
    assert hit / n >= 0.9


# --- 2 -------------------------------------------------------------------------------------------------------------------------


def test_escapes_are_reversible():
    r = random.Random(1)
    parts = ["<", "|", "im_", "end", "|>", "s>", "/", "[INST]", "\\", "<s>", "x", "<|im_end|>", "<|im_start|>", "]"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        held = chat.escape(text)
        assert chat.unescape(held) == text and not any(c in held for c in chat.CONTROLS)


def test_templates():
    assert chat.render("{% set n = 'x' ~ 3 %}{% if 1 == 2 %}no{% elif n in 'ax3' %}{{ n | upper }}{% endif %}{# c #}{% for m in messages %}{{ loop.index }}{{ ',' if not loop.last else '.' }}{% endfor %}", [{}, {}])[0] == "X31,2."
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if true %}d{% else %}e{% endif %}")) == [chat.Text(chat.Const("abcd"))]
    for bad in ("{{ x.__class__() }}", "{{ x | open }}", "{% import x %}", "{% if x %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.render("{{ messages.__class__ }}", [])[0] == ""


@pytest.mark.parametrize("body", ["{{ 1 + 'a' }}", "{{ 'a' < 2 }}", "{{ 3 | length }}", "{{ role + 1 + 'a' }}"])
def test_constants_of_unlike_kinds_are_refused(body):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(body)


@pytest.mark.parametrize("template", ["no loop", "{% for m in messages %}{{ m.text }}{% endfor %}{% for m in messages %}{{ m.role }}{% endfor %}", "{{ messages | length }}{% for m in messages %}{% endfor %}",
    "{{ messages[0].text }}", "{% set messages = none %}{% for m in messages %}x{% endfor %}", "{% if true == x %}{% for m in messages %}x{% endfor %}{% endif %}"])
def test_templates_that_read_turns_otherwise_are_refused_for_tables(spark, template):
    turns = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    with pytest.raises(chat.TemplateError):
        chat.format_conversations(turns, template)
    chat.render(template, [{"role": "user", "text": "hi"}])


@pytest.mark.parametrize("row", [60, 1 << 18])
def test_conversations_read_back(spark, row, monkeypatch):
    monkeypatch.setattr(chat, "ROW", row)
    r = random.Random(3)
    turns = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice([None, "", "hi </s>", "<|im_end|>\n\\", "x" * 50]), 9) for c in [*range(8), None] for t in [*range(r.randint(1, 6)), 0]]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, part long")
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(frame)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t, ro or "", x or "") for k, t, ro, x, _ in turns if k == c)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256("".join(f"{ro}\n{x}\n" for _, ro, x in own).encode()).hexdigest())
        loss = "".join(x for _, ro, x in own if ro == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole = chat.render(chat.TEMPLATE, [{"role": ro, "text": x} for _, ro, x in own])[0]
        assert got[c].formatted_chars == len(whole)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


# --- 3 -------------------------------------------------------------------------------------------------------------------------


def test_mix(spark, docs, none):
    placed, sources, taken = mixing.mix(docs, block=50)
    rows = {s.source: s for s in sources.collect()}
    sizes = collections.Counter()
    for d in docs.collect():
        sizes[d.source] += len(words(d.text))
    assert {k: v.source_size for k, v in rows.items()} == dict(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(rows, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in rows if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in rows}
        over = {s for s in rows if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    got = collections.Counter()
    each = collections.Counter()
    for t in taken.collect():
        got[t.source] += t.to_word - t.from_word
        each[t.source, t.start] += t.to_word - t.from_word
    for s in rows:
        assert rows[s].target == pytest.approx(target[s])
        assert abs(got[s] - target[s]) <= 1
    size = {(p.source, p.start): p.size for p in placed.where("size > 0").collect()}
    assert all(n <= 3 * size[k] for k, n in each.items())
    assert sorted(taken.collect()) == sorted(mixing.mix(docs, block=50)[2].collect())
    assert [f.count() for f in mixing.mix(none)] == [0, 0, 0]


def test_schedule_is_even(spark, docs):
    _, _, taken = mixing.mix(docs, block=20)
    slots = [t.source for t in taken.dropDuplicates(["slot"]).orderBy("slot").collect()]
    half = collections.Counter(slots[: len(slots) // 2])
    for s, n in collections.Counter(slots).items():
        assert abs(half[s] - n / 2) <= 3


def test_ranks_are_counts_of_earlier_slots(spark):
    """Against the points themselves: which source each slot is, and how many of that source's slots come before it."""
    rows = [("a", 50, 50.0, 50, 0, 1 << 30), ("b", 20, 20.0, 20, 1 << 30, 3 << 29), (None, 7, 7.0, 7, 3 << 29, (3 << 29) + 3), ("d", 9, 9.0, 9, (3 << 29) + 3, 1 << 31), ("none", 0, 0.0, 0, 1 << 31, 1 << 31)]
    sources = spark.createDataFrame(rows, "source string, source_size long, target double, quota long, lo long, hi long")
    got = {(r.slot, r.source): (r.rank, r.n_slots) for r in mixing.schedule(spark, sources, 300).collect()}
    expected, seen = {}, collections.Counter()
    for slot in range(300):
        point = int(f"{slot:031b}"[::-1], 2)
        source = next(s for s, *_, lo, hi in rows if lo <= point < hi)
        expected[slot, source] = seen[source]
        seen[source] += 1
    assert {k: v[0] for k, v in got.items() if k[0] < 300} == expected
    assert all(n == seen[s] for (slot, s), (_, n) in got.items() if slot < 300)
    assert {k for k in got if k[0] == 300} == {(300, s) for s, _, _, q, *_ in rows if q and not seen[s]}


def test_stage_mixes_rows_without_ids(spark):
    """Each source gives its quota to within a document, also one of null ids, and one whose rows all share an id; each row has its own copies."""
    r = random.Random(31)
    text = lambda i: f"mark{i} " + " ".join(r.choice(WORDS) for _ in range(r.randint(5, 60)))
    ids = {"a": lambda i: i, "b": lambda i: None, "c": lambda i: 7000}
    rows = [(ids[s](i), text(i), s) for i, s in enumerate("abc" * 150)] + [(None, None, "a"), (None, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    out = mixing.stage(spark, docs, "").collect()
    assert {tuple(x) for x in out} <= set(rows)
    _, sources, _ = mixing.mix(docs)
    got, most = collections.Counter(), collections.Counter()
    for x in out:
        got[x.source] += len(words(x.text))
        most[x] += 1
    for q in sources.collect():
        assert abs(got[q.source] - q.quota) <= 61
    assert max(most.values()) <= mixing.CAP


# --- 4 -------------------------------------------------------------------------------------------------------------------------


def all_paths(model, part):
    arcs = model.arcs(part)

    def back(end):
        if end == 0:
            yield 0, ()
        for at, score, ids in arcs[end]:
            for s, x in back(at):
                yield s + score, x + ids

    return sorted(-s for s, _ in back(len(part)))


def test_nbest_is_exact():
    model = pieces.Lattice(MODEL)
    for part in ("  the cat", " banana", "\n", " é漢x", " inininin"):
        assert [-c.score for c in model.search(part, 6)] == all_paths(model, part)[:6]
        model.learn([part])
        assert model.best(part) == model.search(part, 2)[0]
    text = "the cat sat on inin it"
    choices = [model.search(p, 8) for p in pieces.PARTS.findall(" " + text)]
    expected = sorted(-sum(c.score for c in combination) for combination in itertools.product(*choices))[:6]
    found = model.nbest(text, 6)
    assert [-s for s, _ in found] == expected
    for score, edits in found[1:]:
        ids = list(found[0][1][0][2])
        for at, gone, new in reversed(edits):
            ids[at : at + gone] = new
        assert model.decode(ids) == text and sum(model.scores[i] for i in ids) == score


def test_long_parts_are_searched_in_windows():
    """A text without a blank: the windows change nothing, pieces meet across their ends, and alternatives are edits as ever."""
    model = pieces.Lattice(MODEL)
    r = random.Random(41)
    part = "".join(r.choice("etaoin漢sh12é") for _ in range(3 * pieces.WINDOW + 7))
    one = [0]
    for end, here in enumerate(model.arcs(part)[1:], 1):
        one.append(max(one[at] + score for at, score, _ in here))
    found = model.search(part, 4)
    assert found[0].score == one[-1] and len({tuple(c.ids) for c in found}) == 4 and sorted(found, key=lambda c: -c.score) == found
    for c in found:
        assert b"".join(model.bytes[i] for i in c.ids).decode() == part
    text = "a " + part + " b"
    best, *others = model.nbest(text, 4)
    assert model.decode(best[1][0][2]) == text and len(others) == 3
    for _, edits in others:
        ids = list(best[1][0][2])
        for at, gone, new in reversed(edits):
            ids[at : at + gone] = new
        assert model.decode(ids) == text


def test_search_agrees_with_library(tmp_path):
    """A unigram model with the same pieces: the library's own search gives the same scores."""
    import sentencepiece

    with open(MODEL, "rb") as f:
        raw = bytearray(f.read())
    at = raw.index(b"tok_v0") + len(b"tok_v0")
    assert raw[at : at + 2] == b"\x18\x02"  # model type: byte pairs
    raw[at + 1] = 1
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    model, library = pieces.Lattice(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for word in ("hello", "world", "thetion", "banana", "inster", "Quick"):
        theirs = [sum(model.scores[i] + 1 for i in ids) for ids in library.nbest_encode(word, nbest_size=4)]
        ours = [c.score + len(c.ids) for c in model.search(" " + word, 4)]
        assert ours == theirs


def test_pieces_round_trip(spark, docs, none):
    texts = ["", " ", "  a", "▁x ▁", "\n\n a\t漢😀", "a" * 3000, "x\x00y", None]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score long")
    coded = pieces.encode(frame.select("doc_id", "text"), MODEL)
    assert {r.doc_id: r.text for r in pieces.decode(coded.select("doc_id", "ids"), MODEL).collect()} == {i: t or "" for i, t in enumerate(texts)}
    for table in (frame, docs):
        text = {r.doc_id: r.text for r in table.collect()}
        for r in pieces.pieces(table, MODEL).collect():
            assert r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.n_pieces == len(r.ids)
    assert pieces.pieces(none, MODEL).count() == 0


def test_stage_encodes_and_decodes(spark, docs):
    out = pieces.stage(spark, docs, "").collect()
    row = lambda d, crc: (d.doc_id is None, d.doc_id or 0, str(d.lang), str(d.source), crc)
    assert sorted(row(x, x.text_crc32) for x in out) == sorted(row(d, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    best = {(x.doc_id, x.n_pieces, x.score) for x in out}
    assert best == {(x.doc_id, len(x.ids), x.score) for x in pieces.encode(docs.select("doc_id", "text"), MODEL, 1).collect()}
    assert any(x.others for x in out) and all(o.score <= x.score and o.edits for x in out for o in x.others) and max(len(x.others) for x in out) == 3


# --- 5 -------------------------------------------------------------------------------------------------------------------------


def union(n, pairs):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_fingerprints_match_spark(spark):
    from pyspark.sql import functions as F

    shingles = ["a b c d", "b c d e"]
    h = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    expected = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 2)
    assert simhash.fingerprint("A b\tC d\n e", 4) == expected
    assert simhash.fingerprint("b c", 4) == spark.createDataFrame([("b c",)], "s string").select(F.xxhash64("s")).first()[0] % (1 << 64)
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0


@pytest.mark.parametrize("tile", [8, 1 << 16])
def test_links_lose_nothing(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(8)} | {0, 1, 2**64 - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {x.node: x.root for x in simhash.components(simhash.link_forest(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    low = union(len(fps), pairs)
    for i, j in itertools.combinations(range(len(fps)), 2):
        same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
        assert same == (low[i] == low[j])


def test_classes(spark, docs, none):
    rows = docs.collect()
    fps = [simhash.fingerprint(r.text, 4) for r in rows]
    low = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[low[i]] = min(least.get(low[i], 1 << 60), r.doc_id)
    expected = sorted((r.doc_id is None, r.doc_id or 0, least.get(low[i])) for i, r in enumerate(rows))
    got = sorted((x.doc_id is None, x.doc_id or 0, x.component_id) for x in simhash.classes(docs, 4).collect())
    assert got == expected
    assert simhash.classes(none, 4).count() == 0


def test_stage_keeps_one_of_near_copies(spark):
    r = random.Random(6)
    rows = []
    for i in range(40):
        text = [r.choice(WORDS) + str(r.randint(0, 500)) for _ in range(200)]
        rows.append((2 * i, " ".join(text)))
        if i % 2:
            text[r.randrange(200)] = "changed"
            rows.append((2 * i + 1, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in simhash.stage(spark, docs, "").collect()} == {2 * i for i in range(40)}


def jaccard(a, b, k=5):
    one, other = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(one & other) / len(one | other)


def test_similar_finds_pairs_at_the_threshold(spark):
    """Pairs of Jaccard 0.75 to 0.85, two edits or more apart: those of 0.8 and above are one class, those below are not."""
    r = random.Random(21)
    rows, near = [], []
    while len(rows) < 1200:
        one = [r.choice(WORDS) + str(r.randint(0, 2000)) for _ in range(200)]
        other = list(one)
        for at in r.sample(range(200), r.randint(3, 6)):
            other[at] = "changed" + str(r.randint(0, 2000))
        a, b = " ".join(one), " ".join(other)
        if 0.75 <= (j := jaccard(a, b)) <= 0.85:
            near.append((len(rows), j >= 0.8))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert not [i for i, same in near if not same and got[i] == got[i + 1]]
    wanted = [i for i, same in near if same]
    found = sum(got[i] == got[i + 1] for i in wanted)
    print(f"{found} of {len(wanted)} pairs found")
    assert found >= 0.98 * len(wanted)


def sharing(spark, rows, cluster=7, similarity=0.8):
    """The pairs that the last pass verifies, of rows (sig, label, text); the middle is the first text."""
    sets = [simhash.shingle_set(t, 5).view(np.int64).tolist() for _, _, t in rows]
    table = spark.createDataFrame([(cluster, s, l, h, sets[0]) for (s, l, _), h in zip(rows, sets)], "cluster long, sig long, label long, hashes array<long>, middle array<long>")
    keyed = table.mapInArrow(simhash._prefixes(similarity), "k long, sig long, label long, size long, place long")
    return {(x.a, x.b) for x in simhash._dealt(keyed, "sig", True).mapInArrow(simhash._sharing(similarity), "a long, b long").distinct().collect()}


def test_dense_groups_of_unlike_texts_make_few_pairs(spark):
    r = random.Random(5)
    base = [r.choice(WORDS) + str(r.randint(0, 300)) for _ in range(200)]
    rows = [(0, 0, " ".join(base))]
    for i in range(1, 400):
        text = list(base)
        for at in r.sample(range(200), 3 if i % 2 else 12):
            text[at] = f"x{r.random()}"
        rows.append((i, 0 if i % 2 else i, " ".join(text)))  # the odd ones are linked with the middle; the even ones aren't similar to any
    assert len(sharing(spark, rows)) < len(rows)


def test_prefixes_lose_no_pair(spark):
    r = random.Random(6)
    rows = []
    for i in range(150):
        text = [f"w{j % 40 if i % 3 else j}" for j in range(r.randint(30, 80))]
        for at in r.sample(range(len(text)), r.randint(0, 4)):
            text[at] = r.choice(["a", "b", f"c{i}"])
        rows.append((i, i, " ".join(text)))
    rows += [(200, 200, "one two"), (201, 201, "")]
    found = sharing(spark, rows)
    expected = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if jaccard(a[2], b[2]) >= 0.8}
    assert len(expected) > 20 and expected <= found


def test_maybe_misses_no_row(spark):
    few = spark.range(0, 5000, 7).select(simhash.F.col("id").alias("of"))
    got = simhash._maybe(spark.range(5000), simhash.F.col("id"), few, simhash.F.col("of")).where("maybe").collect()
    assert {x.id for x in got} >= set(range(0, 5000, 7)) and len(got) < 1000
    assert simhash._maybe(spark.range(9), simhash.F.col("id"), few.limit(0), simhash.F.col("of")).where("maybe").count() == 0


def test_similar_matches_brute_force(spark):
    """Chains of edits, in which a candidate that fails does not hide one that holds; short texts, copies and an id with two texts."""
    r = random.Random(22)
    rows = []
    for _ in range(12):
        text = [r.choice(WORDS) + str(r.randint(0, 500)) for _ in range(150)]
        for _ in range(12):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for at in r.sample(range(150), r.randint(1, 6)):
                text[at] = "new" + str(r.randint(0, 500))
    rows += [(500, "a b"), (501, "A  b"), (502, None), (503, ""), (504, rows[0][1]), (505, rows[0][1]), (505, rows[20][1])]
    low = union(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][0] == rows[j][0] or jaccard((rows[i][1] or "").lower(), (rows[j][1] or "").lower()) >= 0.8])
    expected = {i: min(x for x, c in zip((q[0] for q in rows), low) if c == low[at]) for at, (i, _) in enumerate(rows)}
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


# --- 6 -------------------------------------------------------------------------------------------------------------------------


def test_shards_are_even(spark, docs, none):
    rows = ring.assign(docs, 8).collect()
    n = collections.Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and sum(n.values()) == docs.count()
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    assert sorted((r.key is None, r.key or 0, r.size, r.text_crc32) for r in rows) == sorted((d.doc_id is None, d.doc_id or 0, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert ring.assign(none).count() == 0


def test_admission_is_sequential():
    """Turn by turn, clockwise: the counts alone give what placing one row after the other gives."""
    r = random.Random(8)
    owners = [r.randrange(4) for _ in range(12)]
    counts = {(t, a): r.randint(0, 5) for t in range(6) for a in range(12)}
    total = sum(counts.values())
    room = [total // 4 + (s < total % 4) for s in range(4)]
    filled, expected = [0] * 4, []
    for (t, a), n in sorted(counts.items()):
        for k in range(n):
            at = a
            while filled[owners[at % 12]] == room[owners[at % 12]]:
                at += 1
            s = owners[at % 12]
            expected.append((t, a, k, s, filled[s]))
            filled[s] += 1
    plan = ring.admit(counts, owners, room)
    got = []
    for i, (t, a, first, s, base) in enumerate(plan):
        until = plan[i + 1][2] if i + 1 < len(plan) and plan[i + 1][:2] == (t, a) else counts[t, a]
        got += [(t, a, k, s, base + k - first) for k in range(first, until)]
    assert got == expected


def test_sharding_query_as_a_whole(spark, data):
    """op6 against plain loops over the ring: turn by turn, clockwise from each row's arc, to the first shard with room."""
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r.doc_id: r for r in ring.op6(spark, data).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        raw = (d.text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    n = collections.Counter(r.shard for r in got.values())
    assert set(n) <= set(range(8)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(n[s]))


def test_few_rows_move(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "cast(id as string) AS text")
    before = {r.key: r.shard for r in ring.assign(docs, 8).collect()}
    after = {r.key: r.shard for r in ring.assign(docs, 9).collect()}
    assert sum(before[k] != after[k] for k in before) < 0.35 * len(before)


# --- 7 -------------------------------------------------------------------------------------------------------------------------


def slow_ctw(train, depth):
    """Context-tree weighting by its definition: every context's bit nodes, with counts; and the probability of a next byte."""
    counts = collections.Counter()
    for doc in train:
        b = ctw.END * depth + doc
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                for k in range(8):
                    counts[b[i - d : i], 1 << k | b[i] >> (8 - k), b[i] >> (7 - k) & 1] += 1
    nodes = {(c, n) for c, n, _ in counts}

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    children = collections.defaultdict(list)
    for c, n in nodes:
        if c:
            children[c[1:], n].append((c, n))
    pw, share = {}, {}
    for c, n in sorted(nodes, key=lambda x: -len(x[0])):
        pe = kt(counts[c, n, 0], counts[c, n, 1])
        below = sum(pw[x] for x in children[c, n])
        pw[c, n] = pe if len(c) == depth else np.logaddexp(pe, below) - math.log(2)
        share[c, n] = 1.0 if len(c) == depth else 1 / (1 + math.exp(below - pe))

    def log10(context, byte):
        total = 0.0
        for k in range(8):
            n, bit = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1
            p = 0.5
            for d in range(depth, -1, -1):
                c = context[len(context) - d :]
                z, o = counts[c, n, 0], counts[c, n, 1]
                own = ((o if bit else z) + 0.5) / (z + o + 1)
                w = share.get((c, n), 1.0 if d == depth else 0.5)
                p = w * own + (1 - w) * p
            total += math.log10(p)
        return total

    return log10


def test_ctw_by_definition(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK", 200)
    monkeypatch.setattr(ctw, "PIECE", 120)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("ab ba abc é Cab".split()) for _ in range(r.randint(0, 12))), 1) for i in range(40)] + [(100, None, 1), (101, "", 1), (None, "ab", 1), (3, "ab ba", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, block long")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    text = lambda t: b" ".join((t or "").encode().lower().split()) + ctw.END
    train = [text(t) for i, t, _ in rows if not held(i)]
    log10 = slow_ctw(train, ctw.DEPTH)
    c = collections.Counter(w for d in train for w in [*d[:-1].split(), b""])
    n, v = sum(c.values()), len(c)
    expected = []
    for i, t, _ in rows:
        b = ctw.END * ctw.DEPTH + text(t)
        toks = [*text(t)[:-1].split(), b""]
        score = sum(log10(b[k - ctw.DEPTH : k], b[k]) for k in range(ctw.DEPTH, len(b)))
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        expected.append((i if i is not None else -1, held(i), len(toks), sum(c[w] > 0 for w in toks), n, round(base, 7), round(score, 7)))
    got = [(x.doc_id if x.doc_id is not None else -1, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 7), round(x.score, 7)) for x in ctw.score(frame).collect()]
    assert sorted(got) == sorted(expected)
    assert ctw.score(frame.limit(0)).count() == 0


def test_ctw_sums_to_one():
    keys = ctw.grams(ctw.END * 2 + b"abracadabra", 2)
    u, n = np.unique(keys, return_counts=True)
    context = u[0] >> np.uint64(8) << np.uint64(8)
    every = np.union1d(u, context + np.arange(256, dtype=np.uint64))
    counts = np.zeros(len(every))
    counts[np.searchsorted(every, u)] = n
    p, *_ = ctw.subtree(every, counts, 2, 0)
    own = (every >> np.uint64(8) << np.uint64(8)) == context
    assert p[own].prod(axis=1).sum() == pytest.approx(1)


# --- 8 -------------------------------------------------------------------------------------------------------------------------


def test_quality_features(spark, docs, none):
    def plain(text):
        text = text or ""
        ws = [w.decode() for w in text.encode().split()]
        grams = collections.defaultdict(list)
        for i in range(len(ws) - 4):
            grams[tuple(ws[i : i + 5])].append(i)
        covered = {i + k for g in grams.values() if len(g) > 1 for i in g for k in range(5)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        return len(ws), sum(map(len, ws)), sum(text.count(s) for s in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered)

    r = random.Random(10)
    extra = ["a b c d e a b c d e f", "x\ny\nx\n\n\n x", "#*$%&|<> é", "\n".join(r.choice(["a b c d e f g", "h i j"]) for _ in range(40)), "a " * 7]
    rows = [(1000 + i, t) + (None, None, 1, 2, "k", 3, "f", "r") for i, t in enumerate(extra)]
    every = docs.union(spark.createDataFrame(rows, DOCS))
    text = {d.doc_id: d.text for d in every.collect()}
    for x in quality.features(every).collect():
        n, chars, symbols, dup, rep = plain(text[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert x.base_failed == (n < 10 or 100 * rep > 20 * n)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(every, labels).count() == every.count()
    assert quality.judge(none, labels).count() == 0


def test_binomial(spark):
    from pyspark.sql import functions as F

    cases = [(0, 10), (3, 1000), (5, 1000), (1, 3), (0, 100_000), (480, 100_000)]
    frame = spark.createDataFrame(cases, "x long, n long")
    for r in frame.select("x", "n", quality.binomial_cdf(F.col("x"), F.col("n"), 0.005).alias("p")).collect():
        exact = math.fsum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.005) + (r.n - i) * math.log1p(-0.005)) for i in range(r.x + 1))
        assert r.p == pytest.approx(exact, rel=1e-9) if r.x <= r.n * 0.005 else r.p == 1.0


def test_cutoffs_are_safe(spark):
    rows = [("en", 1, *[0] * 6) for _ in range(3000)] + [("en", 1, 150, *[0] * 5) for _ in range(3)] + [("en", 0, 120, *[0] * 5) for _ in range(50)] + [("de", 1, *[0] * 6) for _ in range(50)] + [("de", 0, 120, *[0] * 5) for _ in range(50)]
    frame = spark.createDataFrame(rows, "lang string, quality int, " + ", ".join(f"bin_{r} int" for r in quality.RULES))
    got = {r.lang: r.cut_symbols for r in quality.cutoffs(frame).collect()}
    assert got == {"en": 0}  # few labels, no cutoff: de rejects nothing


# --- 9 -------------------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_gapped_insults(spark):
    r = random.Random(11)
    clean = [" ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(30)) for _ in range(2000)]
    insults = ["blockhead", "nitwit", "scoundrel"]
    toxic = [" ".join([*x.split()[:10], r.choice(insults), *x.split()[10:]]) for x in clean[:300]]
    model = toxicity.fit(toxic[:200], clean[300:1300], toxic[200:] + clean[1300:1600], np.r_[np.ones(100), np.zeros(300)])
    bad = model.score(["you n.i.t.w.i.t of the", "a BLOCKHEAD he was", "this scoundxrel there", "b l o c k h e a d"])
    good = model.score([None, "", *clean[1600:]])
    assert (bad >= 0.7).all() and (good < 0.7).mean() > 0.99
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")
    assert toxicity.score(docs, toxicity.train(docs, labels)).where("score between 0 and 1").count() == 2
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_query_keeps_its_contract(spark, data):
    """Folds by checksum, predictions by the threshold, labels of the held-out fold never read, and most held-out labels right."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = toxicity.op9(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    fold = lambda r: zlib.crc32(str(r.doc_id).encode()) % 3
    turned = spark.createDataFrame([(r.doc_id, r.quality, 1 - r.toxic if fold(r) == 1 else r.toxic) for r in labels.collect()], labels.schema)
    other = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, turned))
    assert {r.doc_id: r.score for r in other.collect()} == {r.doc_id: r.score for r in got}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)


def test_kernel_by_definition():
    def plain(s, t):
        def f(w):
            out = collections.Counter()
            for i, j, k in itertools.combinations(range(len(w)), 3):
                if k - i < toxicity.SPAN:
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        a, b = f(s), f(t)
        return sum(a[x] * b[x] for x in a) / math.sqrt(sum(v * v for v in b.values()))

    marks, rows = toxicity._weights(["idiot", "banana"])
    z, starts, _ = toxicity.symbols(["idixot nab"])
    own = toxicity.kernel(z[starts[1] :], starts[1:] - starts[1], marks, rows) * toxicity.norms(np.diff(np.r_[starts[1:], len(z)]) - 1)[:, None]
    expected = [[plain(w, t) for t in ("idiot", "banana")] for w in ("idixot", "nab")]
    assert np.allclose(own, expected, rtol=1e-5)


# --- 10 ------------------------------------------------------------------------------------------------------------------------


def test_encoder_matches_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    r = random.Random(12)
    parts = "ab1 \n\t\x0b\x1c\x85\xa0　'sté漢😀!_²½"
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(800)] + ["a<|endoftext|>b", "", " x" * 50]
    for t, ids in zip(texts, token_store.encoder(BPE).texts(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_parts_between_spaces_give_the_ids_of_whole_texts():
    """Blanks of all kinds around spaces, and each distinct pre-token given to the library once."""
    r = random.Random(8)
    signs = [" ", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u3000", "a", "b", "'s", "1", "\u0663", "!", "\u6f22", "\u017f", " the", "z"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["one word, and one word"] * 50
    coder = token_store.Encoder(BPE)
    assert [x.tolist() for x in coder.texts(texts)] == [coder._plain(t) for t in texts]
    given = []
    coder.split = lambda t, split=coder.split: given.append(t) or split(t)
    assert [len(x) for x in coder.texts(["one word, and one word"] * 50)] and max(map(len, given)) <= len("one")  # parts that are held aren't cut again


def test_chunks_of_many_texts_are_those_of_each():
    r = np.random.default_rng(9)
    texts = [r.integers(0, 50_000, n).astype("<u4") for n in (1, 3, 7, 8, 9, 2, 5000, 1, 300, 1, 64, 2000)] + [np.full(3000, 5, "<u4")]
    ids, ends = token_store.cuts_of(texts)
    at = 0
    for x, own in zip(texts, ends):
        assert [e - at for e in own] == token_store.cuts(x) and (ids[at : own[-1]] == x).all()
        at = own[-1]


def test_other_splitters_get_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(BPE, encoding="utf-8") as f:
        file = json.load(f)
    file["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, file["pre_tokenizer"]]}
    path = tmp_path / "digits.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    texts = ["in 1234 years", "", " a  b\n\n99", "x" * 500]
    library = Tokenizer.from_file(str(path))
    assert [token_store.encode(t, str(path)) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert token_store.encode(texts[0], str(path)) != token_store.encode(texts[0], BPE)


def test_store_round_trip(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    at = f"file://{tmp_path}/store"
    token_store.write(docs, at, BPE)
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.checksums(spark, at).collect())
    of = [library.encode(d.text or "", add_special_tokens=False).ids + [2] for d in docs.collect()]
    ids = {}
    for d, x in zip(docs.collect(), of):
        ids.setdefault(d.doc_id, []).append((len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
    start = 0
    order = [r[1] for r in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    for s, i, n, crc in rows:
        assert s == start and (n, crc) in ids[i]
        start += n
    back = token_store.read(spark, at).orderBy("seq", "i").collect()
    assert sum(len(token_store.unpack(bytes(r.payload))) for r in back) == sum(map(len, of))
    chunks = spark.read.parquet(f"{at}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    token_store.write(none, f"file://{tmp_path}/empty", BPE)
    assert token_store.checksums(spark, f"file://{tmp_path}/empty").count() == 0


def test_store_notices_changes(spark, docs, tmp_path):
    at = f"file://{tmp_path}/store"
    token_store.write(docs, at, BPE)
    recipes = spark.read.parquet(f"{at}/recipes").selectExpr("seq", "doc_id", "start", "n_tokens + 1 AS n_tokens", "hashes").collect()
    spark.createDataFrame(recipes, "seq long, doc_id long, start long, n_tokens long, hashes array<binary>").write.mode("overwrite").parquet(f"{at}/recipes")
    with pytest.raises(ValueError):
        token_store.checksums(spark, at)


def test_store_notices_changes_above_the_leaves(spark, docs, tmp_path, monkeypatch):
    """Recipes and level 0 that change together, a damaged upper level, a missing one and a missing root."""
    import shutil

    monkeypatch.setattr(token_store, "FAN", 4)
    at = f"file://{tmp_path}/store"
    token_store.write(docs, at, BPE)
    levels = sorted(p.name for p in (tmp_path / "store/manifest").iterdir() if p.name.startswith("level="))
    assert len(levels) > 3 and token_store.verified(spark, at).count() == docs.count()

    def broken(name, change):
        shutil.copytree(tmp_path / "store", tmp_path / name)
        change(tmp_path / name)
        with pytest.raises(ValueError):
            token_store.verified(spark, f"file://{tmp_path}/{name}")

    def together(to):
        rows = spark.read.parquet(f"file://{at[7:]}/recipes").selectExpr("seq", "doc_id", "start", "n_tokens + 1 AS n_tokens", "hashes")
        rows.write.mode("overwrite").parquet(f"file://{to}/recipes")
        token_store.leaves(spark.read.parquet(f"file://{to}/recipes")).write.mode("overwrite").parquet(f"file://{to}/manifest/level=0")

    def damaged(to):
        rows = spark.read.parquet(f"file://{at[7:]}/manifest/level=2").selectExpr("node", "sha2(hash, 256) AS hash")
        rows.write.mode("overwrite").parquet(f"file://{to}/manifest/level=2")

    broken("together", together)
    broken("damaged", damaged)
    broken("no_level", lambda to: shutil.rmtree(to / "manifest" / levels[1]))
    broken("no_root", lambda to: shutil.rmtree(to / "manifest" / levels[-1]))


def test_crc_and_cuts():
    r = np.random.default_rng(13)
    a, b = r.bytes(1000), r.bytes(777)
    assert token_store.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    ids = r.integers(0, 50_000, 20_000).astype(np.uint32)
    ends = token_store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()
    shifted = np.r_[r.integers(0, 50_000, 100).astype(np.uint32), ids]
    assert len({e + 100 for e in ends} & set(token_store.cuts(shifted))) > 0.9 * len(ends)
    assert token_store.unpack(token_store.pack(np.array([70_000, 1], np.uint32))).tolist() == [70_000, 1]


# --- all -----------------------------------------------------------------------------------------------------------------------


def test_queries_match_sql(spark, data):
    from compare import oracle, rows

    from gridmason.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(oracle(sql, data)), name


CLASH = ("best", "nth", "doc", "h", "size", "copies", "label", "low", "id", "score", "kept", "__row", "__text", "n_words", "row", "fp", "sig")


def clashing(spark, rows):
    """Documents with columns of the names that stages use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH) for r in rows], kinds).repartition(3)


def stage_of(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def edge_rows():
    r = random.Random(51)
    prose = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))
    same = prose(60)
    rows = [(i, prose(r.randint(20, 60)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(1, prose(40), "en", "s1", 1), (None, prose(40), None, None, None), (None, prose(40), None, None, None), (50, None, "en", "s0", 0), (51, "", "de", "s0", 0), (52, " \n\t", None, "s0", 0)]
    return rows + [(60, same, "en", "s0", 1), (61, same, "de", "s1", 1), (61, same, "de", "s1", 1), (None, same, "en", "s2", 1), (70, prose(20_000), "en", "s2", 1), (71, "漢" * 50_000, "en", "s2", 1)]


@pytest.mark.parametrize("name", ["quality rules", "toxicity", "near duplicates", "mixing", "pieces"])
def test_stages_at_the_edges(spark, data, name):
    """Nulls in every column, empty and long texts, repeated rows, an id with two texts, clashing columns, an empty table."""
    rows = edge_rows()
    docs = clashing(spark, rows)
    out = stage_of(name)(spark, docs, data)
    got = out.collect()
    full = collections.Counter((*x, *CLASH) for x in rows)
    words_of = lambda x: len(words(x[1]))
    if name == "pieces":
        assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((x[1] or "").encode()) for x in rows)
    else:
        assert out.columns == docs.columns and set(map(tuple, got)) <= set(full)
        left = collections.Counter(map(tuple, got))
    if name == "quality rules":
        assert all(words_of(x) >= 10 for x in left) and left == collections.Counter({x: n for x, n in full.items() if x in left})
        assert left[(70, *[x for x in rows if x[0] == 70][0][1:], *CLASH)] == 1
    elif name == "toxicity":
        assert left == full
    elif name == "near duplicates":
        expected = collections.Counter(x for x in full if x[1] != rows[-6][1] and words_of(x))
        expected.update(x for x in full if x[0] == 60)
        expected.update(x for x in full if x[0] == 50)
        assert left == expected
    elif name == "mixing":
        assert all(words_of(x) for x in left) and max(n / full[x] for x, n in left.items()) <= mixing.CAP
    assert stage_of(name)(spark, docs.limit(0), data).count() == 0


def plain_duplicates(rows):
    """Of rows (doc_id, text) in order, the places of those that stay: of each class of shingle sets of Jaccard 0.8 or more, the row with the least id."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    alike = lambda a, b: a == b or len(a & b) / max(1, len(a | b)) >= 0.8
    low = union(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j])])
    return {min((i for i in range(len(rows)) if low[i] == c), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for c in set(low)}


def test_pipeline_by_plain_stages(spark, data):
    """run() against each stage's plain form in turn: verdicts row by row, scores on the driver, all pairs of texts, places in the sources' streams, and the lattice on the driver."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    now = docs.where(F.col("doc_id").isin(*kept))
    rows = {r.doc_id: r for r in now.collect()}
    model = toxicity.train(now, labels)
    score = dict(zip(rows, model.score([r.text for r in rows.values()])))
    rows = [r for r in rows.values() if score[r.doc_id] < toxicity.THRESHOLD]
    best = plain_duplicates([(r.doc_id, r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if i in best]
    # a source's slots take its stream from the start, round and round, up to its quota
    digest = lambda r: int(hashlib.md5(f"20|{r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    quotas = {s.source: (s.source_size, s.quota) for s in mixing.mix(docs.where(F.col("doc_id").isin(*[r.doc_id for r in rows])))[1].collect()}
    expected, at = collections.Counter(), collections.Counter()
    for r in sorted(rows, key=digest):
        size, n = quotas[r.source][0], len(words(r.text))
        start = at[r.source]
        at[r.source] += n
        for k in range(mixing.CAP):
            got = max(0, min(quotas[r.source][1], k * size + start + n) - (k * size + start))
            expected[r.doc_id] += 2 * got >= n
    lattice = pieces.Lattice(MODEL)
    text = {r.doc_id: r.text for r in rows}
    found = corpus_pipeline.run(spark, data).collect()
    assert collections.Counter(r.doc_id for r in found) == +expected
    for r in {r.doc_id: r for r in found}.values():
        (total, [(_, _, ids)]), *others = lattice.nbest(text[r.doc_id], 4)
        assert r.ids == list(ids) and r.score == total / pieces.UNIT and r.n_pieces == len(ids) and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert [o.score for o in r.others] == [s / pieces.UNIT for s, _ in others]


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    given = {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = {r.doc_id for r in docs.collect()}
    assert kept and kept < given
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.count() == docs.count()
