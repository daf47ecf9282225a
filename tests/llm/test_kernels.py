import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import _kernels as K
from textloom.llm import benchmark_decontam as B
from textloom.llm import chat_format as C
from textloom.llm import html_extract as H
from textloom.llm import language_id as L
from textloom.llm import media_chunks as M
from textloom.llm import source_mixing as S
from textloom.llm import substring_dedup as D
from textloom.llm import toxicity as X

TEXT = st.text(alphabet="abAB \n\t\x0bé😀.", max_size=60)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6), st.integers(1, 5))
def test_shingle_sets_have_the_size_of_the_sets_of_words(texts, k):
    for text, got in zip(texts, K.shingle_sets(pa.array(texts, pa.string()), k), strict=True):
        w = words(text)
        want = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        assert len(got) == len(want)


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT)
def test_intersections_are_those_of_the_word_sets(a, b):
    x, y = K.shingle_sets(pa.array([a, b]), 2)
    of = lambda t: {tuple(words(t)[i : i + 2]) for i in range(len(words(t)) - 1)} or ({tuple(words(t))} if words(t) else set())
    assert len(np.intersect1d(x, y)) == len(of(a) & of(b))


def test_one_permutation_agreement_follows_similarity():
    rng, one = np.random.default_rng(1), K.OnePermutation(96)
    for n in (5, 40, 2000):
        got = []
        for _ in range(200):
            both = rng.integers(0, 1 << 63, n * 8 // 10 or 1, dtype=np.uint64) * 2
            own = [rng.integers(0, 1 << 63, n // 10 or 1, dtype=np.uint64) * 2 for _ in range(2)]
            a, b = (np.unique(np.concatenate([both, x])) for x in own)
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            got.append((one(a) == one(b)).mean() - j)
        assert abs(np.mean(got)) < 0.03


def test_bands_reach_their_recall():
    bands, rows = K.tuned_bands(0.8, 0.999, 36)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 36


def edit(a, b):
    """Least edit distance of ``a`` to a substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        now = [i]
        for j, d in enumerate(b, 1):
            now.append(min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=20))
def test_myers_distance(a, b):
    want = edit(a, b)
    got = B.myers(a, b, len(a))
    assert got[0] == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd ", min_size=30, max_size=70), st.integers(0, 4), st.randoms())
def test_matcher_finds_what_is_within_the_budget(item, edits, rnd):
    t = B.normalise(item)
    if len(t) < B.MIN_CHARS:
        return
    changed = list(t)
    for _ in range(edits):
        i = rnd.randrange(len(changed))
        rnd.choice([lambda i=i: changed.pop(i), lambda i=i: changed.insert(i, "d"), lambda i=i: changed.__setitem__(i, "c")])()
    text = B.normalise("xyz " + "".join(changed) + " zyx")
    found = B.Matcher([(7, item)], 0.1)(text)
    assert bool(found) == (edit(t, text) <= int(len(t) * 0.1))


def test_language_models_sum_to_one():
    m = L.fit(["the cat sat on the mat", "le chat est sur la table", "a dog", "un chien"] * 3, ["en", "fr", "en", "fr"] * 3)
    for context in ("the", "zzz"):
        at = L._grams(m.numbers(L.symbols([context])[0]), L.ORDER)[-2]
        grams = (at << np.uint64(L.BITS)) & np.uint64((1 << L.BITS * L.ORDER) - 1) | np.arange(len(m.vocab) + 1, dtype=np.uint64)
        assert np.allclose(np.exp(m.log_probs(grams)).sum(axis=0), 1, atol=1e-3)
    _, n = m.entropies(["", None, "12 34", "é"])
    assert list(n > 0) == [False, False, False, True]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a: b"]), st.text(alphabet="\\<>/#: turn\né😀", max_size=12)), max_size=5))
def test_rendering_is_reversible(turns):
    text, spans = C.render(turns)
    assert C.parse(text) == turns
    assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=12), st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5)), max_size=4))
def test_masks_cover_the_spans(sizes, cuts):
    ends = np.cumsum(sizes).tolist()
    offsets = list(zip([0, *ends][:-1], ends, strict=True)) if sizes else []
    n, spans, at = sum(sizes), [], 0
    for gap, length in cuts:
        a = at + gap
        if a + length <= n:
            spans.append((a, a + length))
            at = a + length
    bits, covered = C.mask(offsets, spans)
    assert {i for a, b in covered for i in range(a, b)} == {i for a, b in spans for i in range(a, b)}
    assert [bool(x) for x in bits] == [any(s < b and a < e for a, b in spans) for s, e in offsets]


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=0, max_size=30000).map(lambda b: b.decode("latin-1")))
def test_chunks_cover_the_payload(text):
    payload, n = M.padded(text)
    spans = M.cut(payload)
    assert b"".join(payload[a:b] for a, b in spans) == payload and len(payload) % M.UNIT == 0 and len(payload) >= M.UNIT
    assert all(b - a <= M.MOST for a, b in spans) and all(b - a >= M.LEAST for a, b in spans[:-1])


def test_cuts_realign_after_an_insertion():
    rng = np.random.default_rng(3)
    raw = "".join(map(chr, rng.integers(97, 123, 60000)))
    a, b = (({M.digest(p[i:j]) for i, j in M.cut(p)}) for p in (raw.encode(), b"inserted" + raw.encode()))
    assert len(a & b) > 0.7 * len(a)


def test_minima_are_the_last_of_their_windows():
    rng = np.random.default_rng(2)
    for n in (0, 5, 24, 25, 26, 300):
        values = rng.integers(0, 9, n, dtype=np.uint64)
        want = [i + max(range(25), key=lambda j, i=i: (-int(values[i + j]), j)) for i in range(n - 24)]
        assert D.minima(values, 25).tolist() == want


def test_passages_of_fifty_words_share_an_anchor_in_any_surroundings():
    rng, one = np.random.default_rng(4), K.OnePermutation(36)
    word = lambda i: f"w{i}"
    for _ in range(30):
        passage, found = " ".join(map(word, rng.integers(0, 1 << 40, D.RUN + D.WINDOW - 1))), []
        for _ in range(2):
            before, after = (" ".join(map(word, rng.integers(0, 1 << 40, rng.integers(0, 40)))) for _ in range(2))
            data = np.frombuffer(f"{before} {passage} {after}".encode(), dtype=np.uint8)
            rows = D.unit_batch(pa.array([1]), pa.array([1]), data, np.array([0, len(data)]), 22, 3, one).to_pylist()
            found.append(set(rows[0]["a_hash"]))
        assert found[0] & found[1]


def test_many_signatures_are_those_of_each_set():
    rng, one = np.random.default_rng(5), K.OnePermutation(36)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2 for n in (1, 2, 18, 60, 500)] + [np.full(7, 99, dtype=np.uint64)]
    got = one.many(np.concatenate(sets), np.array([len(s) for s in sets]))
    assert all((g == one(np.unique(s))).all() for g, s in zip(got, sets, strict=True))


def test_flow_meets_targets_and_prefers_first_passes():
    flow = S.min_cost_flow({("a",): 100.0, ("a", "b"): 100.0, ("b",): 10.0}, {"a": 150.0, "b": 90.0}, 2)
    given_ = lambda s: sum(v for (_, t), v in flow.items() if t == s)
    assert abs(given_("a") - 150) < 1e-6 and abs(given_("b") - 90) < 1e-6
    assert sum(v for (p, _), v in flow.items() if p == ("a", "b")) <= 200


def test_targets_stop_at_the_cap():
    t = S.targets({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 315.0, 2)
    assert t["a"] == 20 and abs(sum(t.values()) - 315) < 1e-9 and all(t[s] <= 2 * n for s, n in (("b", 100), ("c", 100)))


PAGE = "<html><head><title>t</title><style>x</style></head><body><nav><a>{0}</a></nav><div class='ad'>{0} buy</div><article><h1>H {0}</h1><p>One &amp; {0}<br><p>Two\n  {0}</p><aside>side</aside></article><div class='comments'>c {0}</div><footer>f {0}</footer></body></html>"


def test_extraction():
    wrapper = H.induce([PAGE.format(i) for i in "abcd"])
    assert H.extract(PAGE.format("z"), wrapper) == "H z\nOne & z\nTwo z"
    assert H.extract(PAGE.format("z"), None) == "H z\nOne & z\nTwo z"
    assert H.extract("", None) == H.extract("<p", None) == ""


def test_constant_blocks_are_template():
    page = "<body><div><p>Welcome to the site</p><p>{0} body text {0}</p><p>{0} more</p></div></body>"
    wrapper = H.induce([page.format(i) for i in "abc"])
    assert H.extract(page.format("q"), wrapper) == "q body text q\nq more"
    assert H.extract(page.format("q"), None) == "Welcome to the site\nq body text q\nq more"


BARE = """<body><h1>Title {0}</h1><div><span><a href=/1>Home</a></span><span><a href=/2>News</a></span></div><div><ul>{1}</ul></div>
<div><p>Lead {0} of the text</p><p>More {0} here, and {0}</p></div><div>Printed by Example House, Main Street</div></body>"""


def test_menu_and_footer_without_any_name_go_and_a_title_outside_stays():
    links = lambda x: "".join(f"<li><a href=/{x}{i}>see {x}{i} too</a></li>" for i in range(3))
    wrapper = H.induce([BARE.format(x, links(x)) for x in "abcdef"])
    assert H.extract(BARE.format("z", links("z")), wrapper) == "Title z\nLead z of the text\nMore z here, and z"
    assert "Home" in H.extract(BARE.format("z", links("z")), None)


def test_a_block_more_on_a_page_is_its_own():
    page = "<body><div><b>Site</b></div>{1}<div><p>{0} one</p><p>{0} two</p></div></body>"
    wrapper = H.induce([page.format(i, "") for i in "abc"])
    assert H.extract(page.format("q", "<div><p>only here</p></div>"), wrapper) == "only here\nq one\nq two"


def test_copies_are_no_evidence():
    assert H.induce(["<p>same</p>"] * 9) is None


def test_articles_headers_and_names():
    two = "<article><h1>A</h1><p>one</p></article><div class=ad-slot>buy</div><article><header><h2>B</h2></header><p class='notice-period'>two</p><section id=related-work>three</section></article>"
    assert H.extract(two, None) == "A\none\nB\ntwo\nthree"
    assert H.extract("<h1>T</h1><p>lead</p><div>" + "word " * 300 + "</div>", None).startswith("T\nlead\nword")
    assert [H.named_boilerplate(x) for x in ("main-menu", "ad-slot", "site-header", "comment-list", "advice", "header-image text", "post-content")] == [True, True, True, True, False, False, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9), st.integers(1, 30))
def test_alignment_matches_most_nodes(a, b, cells):
    shapes = H.Shapes()
    leaf = [shapes.number((x, ""), ()) for x in "pqrs"]
    kinds = [leaf[0], leaf[1], shapes.number(("p", ""), (leaf[1], leaf[2])), shapes.number(("p", ""), (leaf[2], leaf[2], leaf[3]))]
    x, y = tuple(kinds[i] for i in a), tuple(kinds[i] for i in b)

    def most(i, j):
        if i == len(x) or j == len(y):
            return 0
        return max(most(i + 1, j), most(i, j + 1), shapes.size(x[i], y[j]) + most(i + 1, j + 1) if shapes.size(x[i], y[j]) else 0)

    old, H.CELLS = H.CELLS, cells  # also in halves
    try:
        pairs = shapes.align(x, y)
    finally:
        H.CELLS = old
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert sum(shapes.size(x[i], y[j]) for i, j in pairs) == most(0, 0)


def test_deep_and_long_pages_are_aligned_whole():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    long = "<ul>" + "".join(f"<li><b>{i}</b> item</li>" for i in range(3000)) + "</ul>"
    one = H.Extractor()
    for page in (deep, long):
        tree = H.measured(H.parse(page), one.shapes)
        assert len(H.Skeleton(H.skeleton(H.parse(page)), one.shapes).matched(tree, one.shapes)) == len(H.skeleton(tree))


def test_short_items_match_whole_words_only():
    find = B.Matcher([(1, "Short one"), (2, "...")], 0.05)
    assert find(B.normalise("a short one!")) == [(1, 0, 2, 0)] and find(B.normalise("Short one")) == [(1, 0, 0, 0)]
    assert find(B.normalise("a short ones")) == [] and find("") == []


def test_the_nearest_occurrence_is_told():
    item = "the quick brown fox jumps over the lazy dog and runs far away"
    far = item.replace("lazy", "lxxy")
    assert B.Matcher([(1, item)], 0.05)(f"{far} zz {item} q") == [(1, 0, len(far) + 4, 3)]
    assert B.Matcher([(1, item)], 0.05)(f"ab {far} zz {item.replace('dog', 'dig')} q") == [(1, 1, len(far) + 7, 3)]


def test_flows_of_sources_apart():
    groups = S.separate([("a",), ("b",), ("a", "c"), (None,)])
    assert {frozenset(g) for g in groups} == {frozenset({("a",), ("a", "c")}), frozenset({("b",)}), frozenset({(None,)})}


def test_recipes():
    names, frames = [b"a" * 16, b"b" * 16], [b"xyz", b""]
    assert M.listed(M.recipe(names, frames)) == (names, [3, 0])


def test_touching_anchors_make_a_run():
    at = lambda w, d, k: {"word": w, "kdoc": d, "kth": 0, "kword": k}
    assert D.joined_runs([at(30, 2, 5), at(10, 1, 0), at(90, 1, 80)]) == [[10, 56, 1, 0, 0, 2, 0, 31], [90, 116, 1, 0, 80, 1, 0, 106]]


def kneser_ney(texts, size):
    """``p(gram)`` of lists of symbol numbers, by dictionaries: counts at the top, continuations below, one discount an order."""
    counts = {L.ORDER: {}}
    for ids in texts:
        for i in range(len(ids)):
            g = tuple([0] * (L.ORDER - 1) + list(ids))[i : i + L.ORDER]
            counts[L.ORDER][g] = counts[L.ORDER].get(g, 0) + 1
    for n in range(L.ORDER - 1, 0, -1):
        counts[n] = {}
        for g in counts[n + 1]:
            counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

    def p(g):
        if not g:
            return 1 / size
        c = counts[len(g)]
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        same = [v for h, v in c.items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return (max(c[g] - d, 0) if g in c else 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])

    return p


def test_language_models_against_dictionaries():
    texts, langs = ["the cat sat on the mat", "le chat est sur la table", "a dog and a cat", "un chien et un chat", "the end"], ["en", "fr", "en", "fr", "en"]
    m = L.fit(texts, langs)
    fold = [i % 5 == 4 for i in range(len(texts))]
    for k, lang in enumerate(m.langs):
        own = [m.numbers(L.symbols([t])[0]).tolist() for t, y, f in zip(texts, langs, fold, strict=True) if y == lang and not f]
        p = kneser_ney(own, len(m.vocab) + 1)
        for probe in ("the chat", "zebra", "a"):
            ids = m.numbers(L.symbols([probe])[0]).tolist()
            want = -np.mean([np.log(p(tuple([0] * (L.ORDER - 1) + ids)[i : i + L.ORDER])) for i in range(len(ids))])
            assert abs(m.entropies([probe])[0][0, k] - want) < 1e-3


def test_toxicity_scores_against_loops():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, rng.integers(0, 30))) + (" vile" if k % 2 else "") for k in range(60)] + ["", None]
    labels = np.array([k % 2 for k in range(60)] + [0, 1])
    ids = [i[a : b - 1] for i, rows in X.word_ids(pa.array(texts, pa.string())) for a, b in rows]
    m = X.train(ids, labels, ["en"] * 62)
    got = np.concatenate([m.logits(i, rows, m.tables()) for i, rows in X.word_ids(pa.array(texts, pa.string()))])
    pad = m.embed.shape[0] - 1
    for d, z in zip(ids, got, strict=True):
        every = np.concatenate([d, np.full((3, 2), pad)])
        pooled, second = [], []
        for f, w in enumerate(m.filters):
            r = np.array([sum((m.embed[every[p + j, 0]] + m.embed[every[p + j, 1]]) @ w[j] for j in range(len(w))) for p in range(len(d) + 1)])
            pooled.append(r.max(axis=0))
            if f == 0:
                second = np.sort(r, axis=0)[-2] if len(r) > 1 else np.full(r.shape[1], -np.inf)
        want = np.maximum(np.concatenate([*pooled, second]) + m.shift, 0) @ m.out + m.bias
        assert abs(want - z) < 1e-3
