"""Operators on small fixtures: brute force, round trips, nulls, ties, empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb

from textloom.llm import benchmark_decontam, chat_format, html_extract, language_id, media_chunks, near_dedup, source_mixing, substring_dedup, toxicity, url_filter
from textloom.llm._graph import components
from textloom.llm._store import Scratch
from textloom.llm.oracle import ORACLE
from textloom.llm.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(seed, n=400):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8))) for _ in range(n)]


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None)


def jaccard_components(docs, k, percent):
    sets = {}
    for i, text, *_ in docs:
        w = words_of(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return {i: (len(sets[i]), c) for i, c in set_components(sets, percent).items()}


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def set_components(sets, percent):
    """The smallest id that each reaches by pairs that are alike enough; all pairs that share an element are counted."""
    name, holders, common = {i: i for i in sets}, {}, Counter()

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i in sorted(sets):
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    for held in holders.values():
        common.update(itertools.combinations(held, 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            name[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_docs():
    rnd, words, out = random.Random(5), vocabulary(5), []
    for g in range(30):
        base = prose(rnd, words, rnd.choice([3, 8, 40, 150])).split()
        for _ in range(rnd.randint(1, 5)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(doc(len(out), " ".join(copy)))
    return [*out, doc(900, None), doc(901, ""), doc(902, " \t\n"), doc(903, "one"), doc(904, "one")]


def test_near_duplicates_against_brute_force(spark, frame):
    docs = near_docs()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(docs, DOCS), k=4).collect()}
    assert got == jaccard_components(docs, 4, 80)


def changed(rnd, words, text, n):
    out = list(text)
    for j in rnd.sample(range(len(out)), n):
        out[j] = rnd.choice(words)
    return out


def template_docs(seeds, others=40, further=11):
    """For each seed ``others`` texts of one template too far apart for a link, and then two that are just alike enough."""
    words, rnd = vocabulary(11, 3000), random.Random(11)
    base, out = [rnd.choice(words) for _ in range(400)], []
    for seed in seeds:
        rnd = random.Random(seed)
        one = changed(rnd, words, base, 16)
        other = changed(rnd, words, one, further)
        out += [*(changed(rnd, words, one, 14) for _ in range(others)), one, other]
    return [doc(i, " ".join(t)) for i, t in enumerate(out)]


def test_near_duplicates_of_one_template(spark, frame, monkeypatch):
    docs = template_docs([290, 374, 649, 1317])  # their pairs share bands, but no three at the distances of joint buckets
    monkeypatch.setattr(near_dedup, "BLOCK", 20, raising=False)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(docs, DOCS), k=4).collect()}
    assert got == jaccard_components(docs, 4, 80)


def test_near_duplicates_edge_rows(spark, frame):
    assert near_dedup.near_duplicates(frame([], DOCS)).collect() == []
    rows = near_dedup.near_duplicates(frame([doc(None, "a b c d e f"), doc(1, "a b c d e f"), doc(1, "a b c d e f")], DOCS)).collect()
    assert len(rows) == 3 and all(r.kept for r in rows)
    assert near_dedup.drop_near_duplicates(frame([doc(2, "a b c d e f"), doc(1, "a b c d e f"), doc(None, None)], DOCS)).count() == 2


def test_components_of_a_long_path(spark, frame):
    edges = frame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and len(got) == 63


def test_repeats(spark, frame):
    rnd, words = random.Random(6), vocabulary(6)
    passage, line = prose(rnd, words, 60), prose(rnd, words, 40)
    near = line.split()
    near[-1] = "changed"
    docs = [
        doc(1, prose(rnd, words, 30) + " " + passage + " " + prose(rnd, words, 30)),
        doc(2, prose(rnd, words, 25) + "\n" + prose(rnd, words, 9) + " " + passage + "\n" + prose(rnd, words, 25)),
        doc(3, line + "\n" + prose(rnd, words, 30)),
        doc(4, prose(rnd, words, 30) + "\n" + line),
        doc(5, prose(rnd, words, 30) + "\n" + " ".join(near)),
        doc(6, prose(rnd, words, 80)),
        doc(7, None),
        doc(8, ""),
        doc(None, line),
    ]
    rows = substring_dedup.removals(frame(docs, DOCS)).collect()
    assert {(r.doc_id, r.kept_doc_id, r.kind) for r in rows} == {(2, 1, "passage"), (4, 3, "paragraph"), (5, 3, "paragraph")}
    kept = {r.doc_id: r for r in substring_dedup.drop_repeats(frame(docs, DOCS)).collect()}
    assert kept[1].text == docs[0][1] and kept[3].text == docs[2][1] and kept[6].text == docs[5][1] and kept[7].text is None
    assert line not in kept[4].text and passage not in kept[2].text and kept[4].n_chars == len(kept[4].text)
    assert substring_dedup.removals(frame([], DOCS)).collect() == []


def test_repeated_paragraphs_of_one_template(spark, frame):
    docs = template_docs([1, 2], others=250, further=8)
    want = jaccard_components(docs, 5, 80)
    rows = substring_dedup.removals(frame(docs, DOCS)).where("kind = 'paragraph'").collect()
    assert {(r.doc_id, r.kept_doc_id) for r in rows} == {(i, c) for i, (_, c) in want.items() if i != c} != set()


def test_contamination(spark, frame):
    rnd, words = random.Random(7), vocabulary(7)
    item = prose(rnd, words, 20)
    wrong = item[:50] + "zz" + item[50:]
    docs = [doc(1, "Before " + item.upper() + ", after"), doc(2, wrong), doc(3, prose(rnd, words, 50)), doc(4, None), doc(5, item[: len(item) // 2])]
    bench = frame([(10, item), (11, None), (12, "!?"), (10, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in benchmark_decontam.matches(frame(docs, DOCS), bench).collect()}
    assert got == {(1, 10, 0), (2, 10, 2)}
    assert {r.doc_id for r in benchmark_decontam.drop_contaminated(frame(docs, DOCS), bench).collect()} == {3, 4, 5}
    assert benchmark_decontam.matches(frame(docs, DOCS), frame([], "item_id long, text string")).count() == 0


def test_media_round_trip(spark, frame):
    rnd, words = random.Random(8), vocabulary(8)
    long = prose(rnd, words, 6000)
    texts = [long, "x" + long, long, None, "", "é", prose(rnd, words, 100)]
    rows = {r.doc_id: r for r in media_chunks.media(frame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, chunks int")).collect()}
    for i, t in enumerate(texts):
        payload, n = media_chunks.padded(t)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[0][1:] == rows[2][1:] and rows[3][1:] == rows[4][1:]


def test_shared_chunks_are_stored_once(spark, frame):
    rnd, words = random.Random(8), vocabulary(8)
    long = prose(rnd, words, 6000)
    scratch = Scratch(spark, "t")
    _, packs = media_chunks.store(frame([(0, long), (1, "x" + long), (2, long)], "doc_id long, text string"), scratch)
    held = packs.selectExpr("explode(arrays_zip(chunks, frames)) c").where("c.frames is not null")
    assert held.count() == held.selectExpr("c.chunks").distinct().count() and packs.count() == 2


def test_chat(spark, frame):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 1, "assistant", tricky), (1, 0, "user", tricky), (2, 0, None, None), (3, None, "assistant", "é😀 "), (3, 1, "assistant", "b"), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(frame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{tricky}\nassistant\n{tricky}\n") and got[1].loss_sha256 == sha(tricky) and got[1].loss_chars == len(tricky)
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0
    assert got[3].loss_sha256 == sha("é😀 b") and got[None].n_turns == 1
    assert chat_format.formatted(frame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_language(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = language_id.predicted(docs.select("doc_id", "text", "lang"), language_id.trained(docs)).where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert sum(r.lang_pred == r.lang for r in told) >= 0.9 * len(told) and all(0 <= r.score <= 1 for r in told)
    odd = language_id.predicted(frame([doc(1, None), doc(2, "12 !"), doc(3, "")], DOCS), language_id.trained(docs)).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}
    assert language_id.trained(frame([doc(1, "x", None)], DOCS)) is None
    assert language_id.predicted(frame([doc(1, "abc")], DOCS), None).first().lang_pred == "und"


def test_toxicity(spark, frame):
    rnd, words = random.Random(9), vocabulary(9)
    docs = [doc(i, prose(rnd, words, 60) + (" vile" + rnd.choice(words) if i % 3 == 0 else "") * 3) for i in range(900)]
    labels = frame([(i, int(i % 3 == 0)) for i in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame(docs, DOCS), labels)
    told = toxicity.scored(frame([*docs, doc(None, None), doc(1000, "")], DOCS), model).collect()
    held = [r for r in told if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in told) and len(told) == 902
    assert toxicity.fit(frame(docs[:3], DOCS), frame([(0, 1)], "doc_id long, toxic int")) is None


def test_urls(spark, frame):
    rows = [("http://A.com/x", "com/", "allow"), ("http://a.example.com/en/1", "example.com/en/", "block"), ("http://www.example.com/en/1?q", "www.example.com/en/", "allow"), ("http://b.net/es/z", "net/es/", "block"), ("http://com", None, None), (None, None, None), ("noscheme", None, None)]
    pages = frame([(i, u, "h") for i, (u, _, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    for i, (_, rule, verdict) in enumerate(rows):
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict) and got[i].verdict in ("allow", "block")
    assert (got[0].host, got[0].path, got[5].host, got[5].path) == ("a.com", "/x", "", "")
    assert url_filter.judged(frame([], "page_id long, url string")).count() == 0


def test_url_ratio_tells_the_kinds_apart(spark, frame):
    rnd = random.Random(3)
    name = lambda letters: "".join(rnd.choice(letters) for _ in range(8))
    rows = [(i, f"http://{name('abcd')}.com/{name('abcd')}") for i in range(200)] + [(200 + i, f"http://{name('wxyz')}.net/es/{name('wxyz')}") for i in range(200)]
    rows += [(400 + i, f"http://{name('abcd')}.org/{name('abcd')}") for i in range(50)] + [(450 + i, f"http://{name('wxyz')}.org/{name('wxyz')}") for i in range(50)]
    got = {r.page_id: r.verdict for r in url_filter.judged(frame(rows, "page_id long, url string")).collect()}
    assert sum(got[400 + i] == "allow" for i in range(50)) >= 45 and sum(got[450 + i] == "block" for i in range(50)) >= 45


def test_pages(spark, frame):
    page = "<html><body><nav>m {0}</nav><article><p>Text {0}</p></article></body></html>"
    rows = [(i, f"http://h{i % 2}/{i}", page.format(i)) for i in range(12)] + [(50, None, None), (51, "http://x/1", "plain"), (51, "http://x/1", "plain")]
    got = html_extract.extracted(frame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted([(i, f"Text {i}", len(f"Text {i}")) for i in range(12)] + [(50, "", 0), (51, "plain", 5), (51, "plain", 5)])
    assert html_extract.extracted(frame([], "page_id long, url string, html string")).count() == 0


def test_mix(spark, frame):
    docs = [doc(i, "w " * (i % 7 + 1), source=f"s{i % 3}") for i in range(300)] + [(500, None, None, None, None), (501, "a b", None, None, 3)]
    rows = source_mixing.mix(frame(docs, DOCS)).collect()
    by = {}
    for r in rows:
        by.setdefault(tuple(r.pattern), [0, r.target, r.source_size])[0] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(t - target) <= 8 and target <= 2 * size for t, target, size in by.values())
    assert source_mixing.mix(frame([], DOCS)).count() == 0


def test_mix_of_overlapping_sources(spark, frame):
    docs = frame([(i, "w w w w", ["a"] if i < 40 else ["a", "b"]) for i in range(80)], "doc_id long, text string, sources array<string>")
    told = source_mixing.mixed(docs, docs["sources"]).collect()
    assert abs(sum(r.taken for r in told) - 1.5 * 320) <= 8


def test_mix_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, size, source_size, target, taken from ({ORACLE['op10_source_mixing']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op10_source_mixing"](spark, SF).collect()) == want


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)


CLASHES = ("_size", "_key", "_pattern", "_range", "size", "taken", "target", "score", "predicted", "_spans", "_cut", "_id", "_hash", "component", "hash", "th", "text_hash", "h", "host", "layout", "lang_pred", "accepted")


def clashing(frame, docs):
    df = frame(docs, DOCS)
    return df.selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in CLASHES))


def test_extra_columns_of_any_name(spark, frame):
    rnd, words = random.Random(3), vocabulary(3)
    passage = prose(rnd, words, 70)
    docs = [doc(i, prose(rnd, words, 40) + (" " + passage if i < 3 else "") + (" vile" if i % 3 == 0 else ""), source=f"s{i % 2}") for i in range(60)]
    df = clashing(frame, docs)
    labels = frame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    for out in (toxicity.drop_toxic(df, labels), substring_dedup.drop_repeats(df), near_dedup.drop_near_duplicates(df), benchmark_decontam.drop_contaminated(df, frame([(1, "nothing of the kind")], "item_id long, text string"))):
        assert out.columns == df.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in CLASHES)
    told = source_mixing.mix(df).collect()
    assert all(r.size == len(r.text.split()) and r._key == f"_key{r.doc_id}" for r in told) and len(told) == 60
    model = language_id.trained(df)
    assert all(r.lang_pred == "en" and r.taken == f"taken{r.doc_id}" for r in language_id.predicted(df, model).collect())
    assert media_chunks.media(df).count() == 60


def test_sources_of_any_name(spark, frame):
    docs = frame([(i, "w w w", x) for i, x in enumerate(["a\x01b", "a", "b", None, "null", '"q', ""])], "doc_id long, text string, source string")
    told = {r.source: r.source_size for r in source_mixing.mix(docs).collect()}
    assert len(told) == 7 and set(told.values()) == {3}


def test_passages_go_whole(spark, frame):
    rnd, words = random.Random(21), vocabulary(21, 5000)
    passages = [prose(rnd, words, n) for n in (50, 51, 60, 75, 130) for _ in range(6)]
    around = lambda: prose(rnd, words, rnd.randint(5, 60))
    docs = [doc(2 * i + j, f"{around()} {p} {around()}") for i, p in enumerate(passages) for j in range(2)]
    by = {}
    for r in substring_dedup.removals(frame(docs, DOCS)).collect():
        by.setdefault(r.doc_id, []).append(r)
    for i, p in enumerate(passages):
        text = docs[2 * i + 1][1].encode()
        (r,) = by.pop(2 * i + 1)
        at = text.index(p.encode())
        assert r.kept_doc_id == 2 * i and abs(r.start - at) <= 9 and abs(r.end - at - len(p)) <= 9  # a word beside it may be alike by chance
        assert docs[2 * i][1].encode()[r.kept_start :].startswith(text[r.start : r.end])
    assert not by


def test_repeats_in_one_text_and_in_repeated_rows(spark, frame):
    rnd, words = random.Random(22), vocabulary(22, 3000)
    p, period = prose(rnd, words, 60), prose(rnd, words, 10)
    twice = f"{p} {prose(rnd, words, 20)} {p}"
    docs = [doc(1, twice), doc(1, twice), doc(2, " ".join([period] * 30)), doc(3, prose(rnd, words, 90)), doc(3, prose(rnd, words, 90)), doc(4, "x " * 20000), doc(5, p)]
    kept = {}
    for r in substring_dedup.drop_repeats(frame(docs, DOCS)).collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    assert len(kept[1]) == 2 and all(t.count(p) == 1 for t in kept[1])
    assert period in kept[2][0] and len(kept[2][0].split()) < 120 and len(kept[3]) == 2 and sum(len(t.split()) for t in kept[3]) == 180
    assert len(kept[4][0].split()) < 100 and 5 not in kept


def test_edge_rows_of_all_operators(spark, frame):
    rows = [doc(None, None), doc(None, ""), doc(7, "a b"), doc(7, "a b"), doc(8, "lang " * 30000), (9, "no language", None, None, None)]
    df = frame(rows, DOCS)
    labels = frame([(7, 1), (8, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(df, labels).count() <= 6
    assert toxicity.scored(df, None).where("score = 0").count() == 6
    assert language_id.predicted(df, language_id.trained(df)).count() == 6
    assert media_chunks.media(df).count() == 6 and source_mixing.mix(df).count() == 6
    none = frame([], DOCS)
    assert media_chunks.media(none).count() == 0 and language_id.predicted(none, None).count() == 0
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0 and substring_dedup.drop_repeats(none).count() == 0
    assert benchmark_decontam.matches(none, frame([(1, "x y")], "item_id long, text string")).count() == 0


def test_pages_of_a_host_lose_what_they_share(spark, frame):
    page = "<body><div>Our house rules apply</div><div><p>Text {0} of {0}</p><p>End {0}</p></div></body>"
    rows = [(i, f"http://big/{i}", page.format(i)) for i in range(40)] + [(90, "http://one/1", page.format("z"))] + [(100 + i, "http://copies/1", page.format("c")) for i in range(5)]
    got = {r.page_id: r.text for r in html_extract.extracted(frame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text {i} of {i}\nEnd {i}" for i in range(40))
    assert got[90].startswith("Our house rules") and got[104].startswith("Our house rules")


def test_pages_query_against_a_plain_version(spark):
    by = {}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        by.setdefault(html_extract.re.sub("^[^:]*://([^/?#]*).*$", r"\1", r.url or "").lower(), []).append(r)
    got = {r.page_id: r.text for r in QUERIES["op8_wrapper_induction"](spark, SF).collect()}
    want = {r.page_id: html_extract.extract(r.html or "", html_extract.induce([x.html or "" for x in rows])) for rows in by.values() for r in rows}
    assert got == want


def test_pipeline_stages_on_odd_rows(spark, frame, tmp_path):
    import corpus_pipeline

    rnd, words = random.Random(31), vocabulary(31)
    item = prose(rnd, words, 30)
    docs = [doc(i, prose(rnd, words, 60), source=f"s{i % 3}") for i in range(40)] + [doc(50, None), doc(51, ""), doc(None, "x y z"), doc(52, f"{prose(rnd, words, 20)} {item}"), doc(1, prose(rnd, words, 60)), (53, "last one", None, None, None)]
    frame([(i, i % 2, int(i == 52)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, []):
        df = clashing(frame, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df2 = stage(spark, df, str(tmp_path))
            assert df2.columns == df.columns
            df = spark.createDataFrame(df2.collect(), df.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() <= max(0, df.count())
        assert df.where("doc_id = 52").count() == 0


def brute_ratio(urls):
    """Scores of URLs and their cut, by dictionaries."""
    import math

    fits = lambda h, p, rule: (h == rule.split("/")[0] or h.endswith("." + rule.split("/")[0])) and p.startswith("/" + rule.partition("/")[2])
    keys, counts = {}, {}
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        rest = rest.split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
        rule = max(((len(r), r, v) for v, r in url_filter.RULES if fits(host, path, r)), default=None)
        key = "".join("0" if c in "0123456789" else c if c in "abcdefghijklmnopqrstuvwxyz/._~%-" else "?" for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in host + path))
        keys[url] = key
        at = counts.setdefault(key, [0, 0])
        if rule:
            at[rule[2] == "block"] += 1
    held = {k: hashlib.md5(k.encode()).hexdigest()[0] in "012" for k in counts}
    runs = lambda k: [("^" * 3 + k + "$")[i : i + 4] for i in range(len(k) + 1)]
    levels = {n: {} for n in range(1, 5)}
    for k, (a, r) in counts.items():
        for g in runs(k):
            for n in range(1, 5):
                at = levels[n].setdefault(g[-n:], [0, 0])
                if not held[k]:
                    at[0] += a
                    at[1] += r
    after = {n: {} for n in range(1, 5)}
    for n, level in levels.items():
        for g, (a, r) in level.items():
            t = after[n].setdefault(g[:-1], [0, 0, 0, 0])
            for i, x in enumerate((a, r)):
                t[i] += x
                t[2 + i] += x > 0

    def p(g, i):
        if not g:
            return 1 / url_filter.SYMBOLS
        t = after[len(g)][g[:-1]]
        return (levels[len(g)][g][i] + t[2 + i] * p(g[1:], i)) / (t[i] + t[2 + i]) if t[i] else p(g[1:], i)

    micro = {g: math.floor(abs(x := (math.log(p(g, 0)) - math.log(p(g, 1))) * 1e6) + 0.5) * (1 if x > 0 else -1) for g in levels[4]}
    score = {k: sum(micro[g] for g in runs(k)) // (len(runs(k)) * url_filter.CELL) for k in counts}
    cells = sorted({score[k] for k in counts if held[k] and any(counts[k])})
    total = lambda i, ok: sum(counts[k][i] for k in counts if held[k] and ok(score[k]))
    best = max(((total(0, lambda x, s=s: x >= s) * total(1, lambda x: True) + total(1, lambda x, s=s: x < s) * total(0, lambda x: True), -abs(at), -at) for j, s in enumerate(cells) for at in [math.ceil((s + cells[max(j - 1, 0)]) / 2)]), default=(0, 0, 0))
    return {u: score[k] for u, k in keys.items()}, -best[2]


def test_url_ratio_against_dictionaries(spark):
    got = QUERIES["op1_url_ratio_filter"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), "page_id").collect()
    scores, cut = brute_ratio([r.url for r in got])
    assert {r["cut"] for r in got} == {cut}
    assert sum(scores[r.url] != r.score for r in got) <= len(got) // 100  # logarithms may differ in the last bit
    assert all(r.verdict == ("allow" if r.score >= cut else "block") for r in got if r.rule is None)


def test_near_duplicates_of_a_whole_table_against_all_pairs(spark):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, k=k).collect()}
        want = jaccard_components(docs, k, 80)
        assert got == want and sum(i != c for i, (_, c) in want.items()) > 20


def test_repeats_of_a_whole_table_against_all_pairs(spark):
    df = spark.read.parquet(f"{LARGER}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    places, sets = {}, {}
    for i in sorted(texts):
        at = 0
        for line in (texts[i] or "").split("\n"):
            w = words_of(line)
            if len(w) >= substring_dedup.MIN_WORDS:
                places.setdefault(tuple(w), []).append((i, at + len(line.encode()) - len(line.lstrip(" \t\r\x0b\x0c").encode())))
            at += len(line.encode()) + 1
    for n, w in enumerate(places):
        sets[n] = {w[j : j + 5] for j in range(len(w) - 4)}
    clusters = {}
    for (w, at), c in zip(places.items(), set_components(sets, 80).values(), strict=True):
        clusters.setdefault(c, []).extend(at)
    want = {p for held in clusters.values() for p in held if p != min(held)}
    rows = substring_dedup.removals(df).collect()
    assert {(r.doc_id, r.start) for r in rows if r.kind == "paragraph"} == want and len(want) > 100
    for r in rows:
        if r.kind == "passage":
            part = words_of(texts[r.doc_id].encode()[r.start : r.end].decode())
            assert len(part) == r.n_words >= substring_dedup.PASSAGE_WORDS
    runs = Counter()
    for r in substring_dedup.drop_repeats(df).collect():
        w = words_of(r.text)
        runs.update({tuple(w[j : j + 50]) for j in range(len(w) - 49)})  # across documents
    assert not [g for g, n in runs.items() if n > 1]
