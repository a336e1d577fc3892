"""License scan, WARC, HTML, quality rules and toxicity."""

import collections
import hashlib
import os
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from llm_data import corpus, frame  # noqa: E402
from seriesloom.llm import html_text, licenses, quality_rules, toxicity, warc  # noqa: E402
from seriesloom.llm.queries import LLM_QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


# --- licenses

def test_license_spans_and_coverage(spark):
    notice = licenses.TEMPLATES["Apache-2.0/notice"]
    dropped = notice.split()
    del dropped[6]
    rows = [(1, f"é intro\n{notice} rest", "", "", 1, 1, 1, ""), (2, " ".join(dropped), "", "", 1, 1, 1, ""),
            (3, "nothing here " * 50, "", "", 1, 1, 1, ""), (4, None, "", "", 1, 1, 1, ""), (5, "", "", "", 1, 1, 1, ""),
            (None, "/* RELEASED under the MIT license */", "", "", 1, 1, 1, "")]
    found = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert set(found) == {1, 2, None}
    assert found[1].template == found[2].template == "Apache-2.0/notice" and found[1].coverage == 1.0
    assert rows[0][1].encode()[found[1].start:found[1].end].decode() == notice
    n = len(licenses.words_of(notice.encode())[0])
    assert found[2].matched_words == n - 1 and found[2].coverage == pytest.approx((n - 1) / n)
    assert found[None].template == "MIT/statement"
    assert licenses.scan_licenses(frame(spark, [])).collect() == []


def test_alignment_equals_common_subsequence():
    import random
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(1, 9))]
        b = [rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(0, 9))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert licenses.banded_alignment(a, b, 0, 20)[0] == best[-1][-1]


def test_license_statements_of_the_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = collections.Counter(r.template for r in LLM_QUERIES["op2_license_scan"](spark, SF).collect())
    expected = collections.Counter(k for k, v in licenses.TEMPLATES.items() for d in docs for _ in range(d.text.count(v)))
    assert found == expected and sum(expected.values()) > 5


# --- WARC

PAGES = "page_id long, url string, html string, text string, path string, digest string"


def expected_records(pages):
    groups = collections.defaultdict(list)
    for p in pages:
        groups[p[2] or ""].append(p[0])
    out = []
    for p in pages:
        body = (p[2] or "").encode()
        keeper = max(groups[p[2] or ""], key=lambda i: (i is not None, i or 0))
        revisit = len(body) >= 1000 and p[0] != keeper
        out.append((p[0], len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response",
                    keeper if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [warc.BLOCK_BYTES, 700])
def test_archives_round_trip_with_records_inside_payloads(spark, block):
    inner = warc.record_bytes(99, "u", b"hidden", "d", None, False).decode()
    long = "long " * 400
    pages = [(i, f"http://a/{i}", h, "x", "p", "d") for i, h in enumerate(
        [None, "", "short", "short", long, long, long + "2", inner, "\r\n\r\n" + inner * 3, "é" * 700, "é" * 700,
         "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "WARC/1.1\r\n" * 90])]
    pages += [(None, None, long, "x", "p", "d"), (40, "u" * 20_000, inner + long, "x", "p", "d")]
    archives = warc.write_archives(spark.createDataFrame(pages, PAGES).repartition(2))
    found = sorted((tuple(r) for r in warc.read_archives(archives, block).collect()), key=str)
    assert found == expected_records(pages)


@pytest.mark.parametrize("block", [warc.BLOCK_BYTES, 50_000])
def test_headers_longer_than_the_first_reads(spark, block):
    pages = [(i, "data:" + "u" * n, "h" * 2000 + str(i), "x", "p", "d") for i, n in enumerate((1_500_000, 3, 3_000_000, 9000, 5))]
    archives = warc.write_archives(spark.createDataFrame(pages, PAGES).coalesce(1))
    found = sorted((tuple(r) for r in warc.read_archives(archives, block).collect()), key=str)
    assert found == expected_records(pages)


def test_a_chain_that_stops_raises(spark, tmp_path):
    record = warc.record_bytes(1, "u", b"x" * 50, "d", None, False)
    path = tmp_path / "broken.warc"
    path.write_bytes(record + record.replace(b"Content-Length: 50", b"Content-Length: 5x") + record)
    archives = spark.createDataFrame([(f"file://{path}", path.stat().st_size, 3)], "path string, n_bytes long, n_records long")
    with pytest.raises(ValueError, match="do not lead to its end"):
        warc.read_archives(archives)


def test_archives_of_an_empty_table(spark):
    archives = warc.write_archives(spark.createDataFrame([], PAGES))
    assert warc.read_archives(archives).collect() == []


def test_archives_of_the_test_tables(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    found = sorted((tuple(r) for r in LLM_QUERIES["op3_warc_chain"](spark, SF).collect()), key=str)
    assert found == expected_records(pages)


def test_archives_equal_sql(spark):
    from compare import connect, differences
    from seriesloom.llm.queries import LLM_ORACLE
    for name, sql in LLM_ORACLE.items():
        assert differences(spark, connect(SF), LLM_QUERIES[name], sql, SF) == []


# --- HTML

@pytest.mark.parametrize("source, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two<div>three</div>", "one\n\ntwo\n\nthree"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a    | bbb\ncccc | d"),
    ("<td>x</td><p>y", "x\n\ny"),
    ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("a<script>if (1<2) '</p>'</script><style>p{}</style><!-- no -->b", "ab"),
    ("<p hidden>no<p style='color:red; display : none'>no<p data-x=hidden>yes", "yes"),
    ("a<br>b<br/><b>c</b>  d", "a\nb\nc d"), ("<img alt='pic'> x", "pic x"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("a < b and <unknown>c", "a < b and c"),
    ("<div>" * 3000 + "deep", "deep"), ("<table><td>" * 200 + "deep", "deep"),
    ("<select><option>no</select>after", "after"), ("<textarea>&lt;kept</textarea>", "<kept"), ("x<script>never closed", "x"),
])
def test_layout(source, text):
    assert html_text.visible_text(source).strip("\n") == text


@pytest.mark.parametrize("source, text", [
    ("<html><head><title>t</title><h1>a</h1><p>b", "a\n\nb"), ("<head><meta charset=x>plain", "plain"),
    ("<!doctype html><html><head>\n<title>t</title>\n<link rel=x><style>p{}</style><script>1</script>\n<!-- c --><p>b", "b"),
    ("<head><noscript><img alt=no></noscript><template><p>no</template><div>yes", "yes"),
    ("<head><title>t</title></head>x<p>y", "x\n\ny"), ("<p>x<svg><title>no</title><text>drawn</text></svg>", "xdrawn"),
    ("<svg><defs/><path d='x'/><desc>no</desc><text>drawn</text></svg><p>b", "drawn\n\nb"),
    ("<math><mi>a</mi><mo>+</mo><mi>b</mi></math>", "a+b"),
])
def test_head_that_ends_unsaid_and_shown_elements(source, text):
    assert html_text.visible_text(source).strip("\n") == text


@pytest.mark.parametrize(("source", "text"), [
    ("<p class=it's>one</p><p>it's two</p>", "one\n\nit's two"), ("<p a='>' b=\">\" c = d>x</p>y", "x\n\ny"),
    ("<a href=x/>in</a> out", "in out"), ("<p =a b=>one</p>two", "one\n\ntwo"), ("a < b <3 c", "a < b <3 c"),
    ("one<p title='never ended>two", "one"), ("one <!-- two", "one"), ("one <!two", "one"),
    ("<svg><title/><text>t</text></svg>u", "tu"), ("<img alt=\"a>b\"/>c", "a>bc")])
def test_tags_as_the_tokenizer_reads_them(source, text):
    assert html_text.visible_text(source).strip("\n") == text


@pytest.mark.parametrize("piece", ["<a ", "<a title=\"x", "<a x='", "<!a", "<!--", "</b", "<b></i>", "<a b= ", "</p><i>", "<i><div></b>"])
def test_broken_pages_take_linear_time(piece):
    import time

    def seconds(n):
        start = time.process_time()
        html_text.visible_text("x" + piece * n)
        return time.process_time() - start
    seconds(1000)
    few, many = (seconds(n * 10) for n in (1_000, 10_000))
    assert many < 30 * few + 0.5


def test_extracted_pages(spark):
    pages = [(1, "u", "<p>é", "t", "p", "d"), (1, "u", "<p>é", "t", "p", "d"), (None, None, None, None, None, None)]
    found = html_text.extract_text(spark.createDataFrame(pages, PAGES)).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, "é", 1), (1, "é", 1), (None, "", 0)], key=str)
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).collect() == []


def test_every_shown_word_of_the_test_pages_is_kept(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    texts = {r.page_id: r.text for r in LLM_QUERIES["op4_html_layout"](spark, SF).collect()}
    assert set(texts) == {p.page_id for p in pages}
    for p in pages:
        import html
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "", p.html)
        shown = html.unescape(re.sub(r"<[^>]*>", " ", body))
        if "hidden" not in body and "display" not in body and "noscript" not in body:
            strip = lambda s: re.sub(r"[\s|\-\d.>]+", "", s)
            assert strip(texts[p.page_id]) == strip(shown)


# --- quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i:i + 8])].append(i)
    covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_equal_brute_force(spark):
    rows = corpus(6) + [(900, "a b c d e f g h i\n" * 5, None, "s", 1, 1, 1, "x"), (901, "# | 😀 x\x0b\x0c&\r\n\n \nx", "xx", "s", 1, 1, 1, "x"),
                        (902, "a b c d e f g h a b c d e f g h " * 3, "en", "s", 1, 1, 1, "x"), (None, None, None, None, None, None, None, None)]
    found = {r.doc_id: tuple(r[c] for c in COUNTS) for r in quality_rules.quality_verdicts(frame(spark, rows)).collect()}
    assert found == {r[0]: base_counts(r[1]) for r in rows}
    assert quality_rules.quality_verdicts(frame(spark, [])).collect() == []


def test_verdicts_on_the_test_tables(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = {r.doc_id: r for r in LLM_QUERIES["op6_quality_rules"](spark, SF).collect()}
    assert {i: tuple(r[c] for c in COUNTS) for i, r in found.items()} == {i: base_counts(t) for i, t in docs.items()}
    good = [i for i, q in quality.items() if q == 1 and not found[i].base_failed]
    bad = [i for i, q in quality.items() if q == 0]
    assert sum(found[i].kept for i in good) >= 0.99 * len(good)
    assert sum(found[i].kept for i in bad) <= 0.2 * len(bad)


def test_js_distance(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(*[quality_rules.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias(n) for n, p, q in (
        ("same", (0.5, 0.5), (0.5, 0.5)), ("apart", (1.0, 0.0), (0.0, 1.0)), ("half", (1.0, 0.0), (0.5, 0.5)))]).first()
    assert (row.same, row.apart) == (0.0, 1.0) and row.half == pytest.approx(0.5579230452841438)


# --- toxicity

def test_held_out_toxic_documents_are_found(spark):
    import random
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice("the of and river stone cloud paper window garden".split()) for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(("blarghead", "Snotface", "vermox."))
        rows.append((i, " ".join(w), "en", "s", 1, 0, 1, "x"))
        labels.append((i, int(toxic), 1, "t"))
    rows += [(None, "vermox vermox snotface", "en", "s", 1, 0, 1, "x"), (5000, None, "en", "s", 1, 0, 1, "x"), (5001, "", "en", "s", 1, 0, 1, "x")]
    labels = spark.createDataFrame(labels + [(None, 1, 1, "t"), (3, None, 1, "t")], "doc_id long, toxic int, quality int, text string")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(frame(spark, rows), labels).collect()}
    assert len(found) == len(rows)
    for i, r in found.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if i is not None and i < 600 and r.held_out:
            assert r.predicted == int(i % 6 == 0)
    assert found[None].predicted == 1 and found[5000].predicted == found[5001].predicted == 0
    kept = toxicity.without_toxic(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and None in {r.doc_id for r in kept.collect()}


def test_grams_beyond_the_held_ones_are_not_left_out(spark):
    """Scores by joins, with few words held or none, equal those with the whole model in memory."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(1500).select("doc_id", "text").union(
        spark.createDataFrame([(None, None), (-1, ""), (-2, "... Ünseen ... qqxqqx ...")], "doc_id long, text string"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    whole = {r.doc_id: tuple(r)[2:] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert any(v[0] >= 0.5 for v in whole.values())
    for held in (300, 0):
        found = {r.doc_id: tuple(r)[2:] for r in toxicity.toxicity_scores(docs, labels, max_grams=10, held_words=held).collect()}
        assert found.keys() == whole.keys()
        for i, values in found.items():
            assert values == whole[i]


def test_grams_are_spelled_out_some_words_at_a_time(monkeypatch):
    """Counts add up to those of all words at once; the arrays of all grams are never held together."""
    import tracemalloc
    counts = {"n": collections.Counter({f"word{i % 977}x{i}": 1 + i % 3 for i in range(120_000)})}
    counts["toxic"] = collections.Counter({w: 1 for w in list(counts["n"])[::5]})
    counts["ordinary"] = collections.Counter({w: 1 for w in list(counts["n"])[::7]})

    def summed(words):
        monkeypatch.setattr(toxicity, "SPELLED_WORDS", words)
        total = collections.defaultdict(lambda: [0, 0, 0])
        for batch in toxicity.spelled_out(counts):
            for gram, *values in zip(*[c.to_pylist() for c in batch.columns]):
                total[gram["high"], gram["low"]] = [a + b for a, b in zip(total[gram["high"], gram["low"]], values)]
        return dict(total)

    assert summed(5_000) == summed(120_000)

    def peak(words):
        monkeypatch.setattr(toxicity, "SPELLED_WORDS", words)
        tracemalloc.start()
        for _ in toxicity.spelled_out(counts):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(5_000) < peak(120_000) / 8


ODD_TEXTS = ["Word, word. \x1fWORD\t(word)\n", None, "", " \n ", "a\x1cb\x85c\xa0d\u2003e\u3000f  g", "... «a» .« '' ¿Qué? naïve-x, ΟΔΟΣ İx",
             "日本語、 \u200bword\u200b 𝒳! x_y _z_ ١٢ ²", "word word"]


def plain_words(text):
    """Words as spelled, one by one."""
    words = []
    for w in (text or "").lower().split():
        inner = [i for i, c in enumerate(w) if c.isalnum()]
        words.append(w[inner[0]:inner[-1] + 1] if inner else w)
    return words


def test_distinct_words_are_told_apart_as_by_reading_word_by_word():
    for texts in (ODD_TEXTS, ODD_TEXTS[1:4], ODD_TEXTS[4:5]):
        words, which, sizes = toxicity.spelled_words([(t or "").encode() for t in texts])
        assert len(set(words)) == len(words)
        assert [words[i] for i in which] == [w for t in texts for w in plain_words(t)]
        assert sizes.tolist() == [len(plain_words(t)) for t in texts]


def test_gram_counts_by_brute_force(spark):
    rows = [(i, t, f, y) for i, t in enumerate(ODD_TEXTS) for f, y in ((2, 1), (2, 0), (3, None), (0, 1), (1, 0), (None, 1))]
    expected = collections.defaultdict(lambda: [0, 0, 0])
    for _, t, f, y in rows:
        for w in plain_words(t):
            padded = toxicity._START * 5 + w + toxicity._END
            for i in range(len(w) + 1):
                halves = [sum(ord(c) << 21 * (2 - k) for k, c in enumerate(padded[j:j + 3])) for j in (i, i + 3)]
                for k, counted in enumerate((True, f in (2, 3) and y == 1, f in (2, 3) and y == 0)):
                    expected[tuple(halves)][k] += counted
    docs = spark.createDataFrame(rows, "doc_id long, text string, fold long, toxic int")
    found = {tuple(r.gram): [r.n, r.toxic, r.ordinary] for r in toxicity.gram_counts(docs).collect()}
    assert found == dict(expected)


def test_each_distinct_gram_is_looked_up_once(monkeypatch):
    import numpy as np
    words = [f"{a}{b}tion" for a in "abcdefgh" for b in "ijklmnop"] * 50
    grams = {(h, l) for h, l in zip(*[x.tolist() for x in toxicity.spelling_grams(words)[:2]])}
    keys = np.sort(toxicity._keys(*map(np.array, zip(*grams))))
    model = toxicity.Model(keys, np.arange(len(keys), dtype=np.int32), keys[:0], np.zeros(0, np.int32))
    high, low, starts = toxicity.spelling_grams(words)
    places = {k: i for i, k in enumerate(keys.tolist())}
    values = [places[k] for k in toxicity._keys(high, low).tolist()]
    expected = np.add.reduceat(np.array(values), starts) / toxicity.SCALE
    wanted, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: wanted.append(len(v)) or search(a, v, *rest))
    assert model.word_ratios(words).tolist() == expected.tolist()
    assert sum(wanted) == len(grams) < len(high) / 10


def test_grams_of_all_scripts_differ():
    letters = "abcäéкотѕ日本語中文हिन्दीعرب𝒳😀ก\x02"
    words = sorted({a + b + c for a in letters for b in letters for c in letters})
    high, low, starts = toxicity.spelling_grams(words)
    assert starts.tolist() == [4 * i for i in range(len(words))] and len(high) == 4 * len(words)
    spelled = {(f"{toxicity._START * 5}{w}{toxicity._END}")[i:i + 6] for w in words for i in range(4)}
    assert len(set(zip(high.tolist(), low.tolist()))) == len(spelled) == len(set(toxicity._keys(high, low).tolist()))


def test_model_reaches_workers_without_the_package(tmp_path):
    import pickle
    import subprocess
    import sys

    import numpy as np
    model = toxicity.Model(np.zeros(1, np.uint64), np.zeros(1, np.int32), np.zeros(1, np.uint64), np.zeros(1, np.int32))
    (tmp_path / "model").write_bytes(pickle.dumps(tuple(model)))
    subprocess.run([sys.executable, "-I", "-c", "import pickle; pickle.load(open('model', 'rb'))"], cwd=tmp_path, check=True)


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    rows = corpus()[:30]
    assert {r.score for r in toxicity.toxicity_scores(frame(spark, rows), none).collect()} == {0.0}
    assert toxicity.toxicity_scores(frame(spark, rows), one).count() == 30
    assert toxicity.toxicity_scores(frame(spark, []), one).collect() == []


def test_accuracy_on_the_test_tables(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    found = LLM_QUERIES["op10_toxicity_models"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    judged = [(r.score, labels[r.doc_id]) for r in found if r.doc_id in labels]
    pairs = wins = 0
    clean = sorted(s for s, y in judged if y == 0)
    import bisect
    for s, y in judged:
        if y == 1:
            wins += bisect.bisect_left(clean, s)
            pairs += len(clean)
    assert wins / pairs > 0.93
    assert sum(r.predicted for r in found if labels.get(r.doc_id) == 0) <= 0.005 * len(clean)
