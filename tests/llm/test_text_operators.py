import hashlib
import math
import os
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from effectsmith.llm import bpe, html_text, langid, lm, quality, simhash, toxicity

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], DOCS)


# --- BPE ---


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "  ", "Hello I'm don't WE'LL 'tis", "x<|endoftext|>y <|startoftext|>", "ΑΣ Σ İstanbul ß", "é ﬁ ½ ④ 12345", "a\x1cb\x85c\u3000d", "!!! --- 😀👩‍👩", "z" * 3000, "naïve\r\n\tword"]
    rng = np.random.default_rng(3)
    texts += ["".join(chr(int(c)) for c in rng.integers(32, 0x2FFF, 40)) for _ in range(50)]
    own, theirs = bpe.SegmentTreeBPE(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in texts:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    rows = bpe.encoded(docs_of(spark, texts).withColumn("ids", F.lit(1)), VOCABULARY).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(own.encode(t)) for i, t in enumerate(texts)}
    assert bpe.digests(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    twice = docs_of(spark, texts).unionByName(docs_of(spark, texts)).selectExpr("*", "'x' as ids", "1 as n_tokens")
    found = bpe.digests(twice, VOCABULARY).collect()
    assert len(found) == 2 * len(texts)
    for r in found:
        ids = theirs.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids_sha256"], r["decoded_sha256"]) == (digest(" ".join(map(str, ids))), digest(theirs.decode(ids, skip_special_tokens=False)))


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="needs the vocabulary file")
def test_bpe_equals_the_library_on_all_planes():
    from tokenizers import Tokenizer

    own, theirs = bpe.SegmentTreeBPE(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    r = random.Random(9)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    texts = ["a\u036e\u08d3", "q\u0898\u0345"]
    texts += ["".join(r.choice(marks if r.random() < 0.6 else every if r.random() < 0.5 else "aéqΩ ") for _ in range(r.randint(1, 8))) for _ in range(20_000)]
    expected = theirs.encode_batch(texts, add_special_tokens=False)
    got = list(own.coded(texts))
    wrong = [t for t, e, (ids, _) in zip(texts, expected, got, strict=True) if ids.decode() != " ".join(map(str, e.ids))]
    assert [t.encode("unicode-escape") for t in wrong] == []


# --- HTML ---


def test_article_text_without_furniture():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>H</header><nav><ul><li>menu</ul></nav>"
        "<article><h1>Ti&amp;tle</h1><p>One  two<br>three<p><b>four</b> fi<i>ve</i><div class='ad'>buy</div><aside>s</aside><!-- c --><form>f</form>"
        "<section class='comments'><p>first!</p></section><p>&#233;nd&nbsp;x</p></article><footer>&copy; F</footer></body></html>"
    )
    assert html_text.main_texts([(1, page)]) == ["Ti&tle One two three four five énd x"]
    assert html_text.main_texts([(1, None), (2, ""), (3, "<p"), (4, "plain < text")]) == ["", "", "<p", "plain < text"]


def test_runs_repeated_on_a_host_are_removed():
    line = "this line stands on every page of the host"
    pages = [(i, f"<div>{line}</div><div>only page {i} says number {i} here</div>") for i in range(4)]
    assert html_text.main_texts(pages) == [f"only page {i} says number {i} here" for i in range(4)]
    assert html_text.main_texts(pages[:2])[0].startswith(line)
    assert html_text.main_texts([pages[0]] * 4)[0].startswith(line)  # one page, four times


def article_pages(n, banner_on, host="a.x"):
    banner = "read this banner about our cookies on every page"
    return [
        (i, f"http://{host}/{i}", "<nav>home news about help</nav><article>" + (f"<p>{banner}</p>" if i < banner_on else "") + f"<p>article {i} says this and {i * 7} that in its own words</p></article>")
        for i in range(n)
    ]


def test_a_template_inside_articles_goes_and_a_copied_passage_stays():
    for n, on, gone in ((6, 6, True), (6, 3, True), (8, 3, False), (2, 2, False)):
        texts = html_text.main_texts([(i, page) for i, _, page in article_pages(n, on)])
        assert ["banner" in t for t in texts] == [not gone and i < on for i in range(n)], (n, on)
        assert all(f"article {i} says this" in t and "home" not in t for i, t in enumerate(texts))


def test_a_teaser_is_not_all_main_text():
    page = "<article>teaser of it</article><div>the long main text stands outside of any article here</div>"
    assert html_text.main_texts([(1, page)]) == ["teaser of it the long main text stands outside of any article here"]
    assert html_text.main_texts([(1, "<article>the whole long article</article><div>loose end</div>")]) == ["the whole long article"]


def brute_extraction(rows):
    """Windows counted in a dictionary instead of an array."""
    hosts = {}
    for i, url, source in rows:
        hosts.setdefault(re.match(r"https?://([^/]*)", url)[1] if url else ("none", i, source), []).append((i, source))
    out = []
    for members in hosts.values():
        read = {m: html_text.blocks_of(m[1]) for m in members}
        on = {}
        for m, blocks in read.items():
            for _, t in blocks:
                words = t.split(" ")
                for j in range(len(words) - 5):
                    on.setdefault(tuple(words[j : j + 6]), set()).add(m)
        for m in members:
            kept = []
            for place, t in read[m]:
                words, gone = t.split(" "), set()
                for j in range(len(words) - 5):
                    least = max(3, -(-len(read) // 2) if place == 1 else -(-len(read) // 100))
                    if len(on[tuple(words[j : j + 6])]) >= least:
                        gone |= set(range(j, j + 6))
                if place != 2 and (left := [w for j, w in enumerate(words) if j not in gone]):
                    kept.append((place, left))
            n = {p: sum(len(w) for q, w in kept if q == p) for p in (0, 1)}
            out.append((m[0], " ".join(" ".join(w) for p, w in kept if p == 1 or n[1] < n[0])))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_pages", [1000, 4])
def test_extraction_equals_brute_force_whatever_slices_and_partitions(spark, slice_pages):
    rows = article_pages(9, 9, "big.x") + [(100 + i, u, p) for i, u, p in article_pages(30, 16, "hot.x")] + [(200 + i, u, p) for i, u, p in article_pages(30, 12, "other.x")]
    rows += [(300 + i, f"http://loose.x/{i}", f"<div>the same loose line on each page</div><p>but own {i} words</p>") for i in range(8)]
    rows += [(400, None, "<p>read this banner about our cookies on every page</p>"), (401, "http://long.x/1", "<article>" + "many words " * 20_000 + "</article>"), (None, "http://hot.x/n", None), (100, *rows[9][1:])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 6):
        got = sorted(((r["page_id"], r["text"]) for r in html_text.extracted(frame.repartition(n), slice_pages).collect()), key=str)
        assert got == brute_extraction(rows)


def test_suffix_array_against_sorting():
    stream = np.random.default_rng(5).integers(0, 3, 300)
    order, rank = html_text.suffix_array(stream, 5)
    key = lambda i: tuple(stream[i : i + 5])
    assert [key(i) for i in order] == sorted(key(i) for i in range(300))
    assert all((rank[i] == rank[j]) == (key(i) == key(j)) for i in range(0, 300, 7) for j in range(0, 300, 11))


def test_suffix_array_of_fewer_tokens_than_its_depth():
    for n in range(1, 6):
        stream = np.arange(n) % 2
        order, rank = html_text.suffix_array(stream, 8)
        assert list(order) == sorted(range(n), key=lambda i: tuple(stream[i:]))  # noqa: B023
        assert len(set(rank.tolist())) == n


def test_word_codes_are_the_same_in_every_window():
    words = sorted({"é", "\0", "\0\0", "a", "aa", "😀", "z" * 5000, *(f"w{i}" for i in range(30_000))})
    together = html_text.codes_of([" ".join(words)])
    alone = html_text.codes_of(words * 3)
    assert together[-1] == 0 and len(set(together.tolist())) >= len(words)  # of 30,000 words 0.1 pairs are expected to meet
    assert (alone[::2] == np.tile(together[:-1], 3)).all() and not alone[1::2].any()
    assert html_text.codes_of([]).tolist() == []


def test_extraction_costs_a_few_scans_of_the_page():
    """CPU time of one slice of a large host through all its steps, in scans of its tags: 20 to 24, 47 before."""
    r = random.Random(2)
    words = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 9))) for _ in range(30_000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    link = lambda: f'<li><a href="/{say(1)}">{say(1)}</a></li>'
    pages = [
        f"<html><head><title>{say(5)}</title><style>p{{}}</style></head><body><nav><ul>{''.join(link() for _ in range(6))}</ul></nav><div class='ad'>{say(6)}</div>"
        f"<article>{''.join(f'<p>{say(40)} &amp; <b>{say(2)}</b><br>{say(5)}</p>' for _ in range(12))}</article><footer>same words below each page of this host</footer></body></html>"
        for _ in range(600)
    ]
    columns = {"host": ["h"] * 600, "slice": [0] * 600, "page": list(range(600)), "page_id": list(range(600)), "url": ["u"] * 600, "html": pages, "hot": [True] * 600}
    first = {"host": "h", "slice": 0, "n": 600, "runs": [1, 2], "counts": [600, 600]}

    batch = pa.RecordBatch.from_pydict(columns)
    coded = list(html_text._coded(iter([batch])))
    parsed = pa.Table.from_batches(html_text._parsed(iter([batch]))).to_pylist()
    dealt = pa.Table.from_pylist([first | dict.fromkeys(["page", "page_id", "url", "places", "texts"]), *(row | dict.fromkeys(["n", "runs", "counts"]) for row in parsed)])
    extract = lambda: [t for out in html_text._extract(iter(dealt.to_batches())) for t in out.column("text").to_pylist()]

    def cost(run):
        times = []
        for _ in range(4):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    scan = cost(lambda: [sum(1 for _ in html_text.TAG.finditer(p)) for p in pages])
    steps = [
        2 * cost(lambda: list(html_text._coded(iter([batch])))),  # for the candidates and for their count
        cost(lambda: list(html_text._candidates(iter(coded)))),
        cost(lambda: list(html_text._page_runs(iter(coded)))),
        cost(lambda: list(html_text._parsed(iter([batch])))),
        cost(extract),
    ]
    assert len(extract()) == 600 and all(" & " in t and "below" not in t for t in extract())
    assert sum(steps) < 36 * scan


def test_extraction_over_hosts(spark):
    rows = [(1, "http://a.x/1", "<article>hi</article>"), (2, None, None), (1, "http://a.x/1", "<article>hi</article>")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == [(1, "hi", 2), (1, "hi", 2), (2, "", 0)]
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- toxicity ---


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"=grob": 2.0, "=vile": 2.0})
    total = lambda t: sum(g.clauses(t))
    assert total(None) == total("") == total("fine text") == 0
    assert total("you are vile") == pytest.approx(3.0) and total("vile") == pytest.approx(2.0)
    assert total("you are not vile") == pytest.approx(1.2)
    assert total("he said that is vile") < total("he is vile")
    assert total("i will kill you") == pytest.approx(toxicity.FIXED_WEIGHT) and total("kill the lights") == 0
    assert len(g.clauses("vile. grob!\nvile")) == 3
    assert g.score("you vile grob, vile") > g.score("vile") > g.score("fine")


def test_composition_equals_running_one_after_another():
    a, b = toxicity.negation_transducer(), toxicity.report_transducer()
    c = toxicity.compose(toxicity.insult_transducer(), toxicity.threat_transducer())
    both = toxicity.compose(toxicity.compose(a, b, toxicity.ALPHABET), c)
    rng = np.random.default_rng(0)
    for _ in range(50):
        line = rng.choice(list(toxicity.ALPHABET), 20)
        s = p = q = r = 0
        for x in line:
            s, out, *added = both.step(s, x)
            p, mid, *_ = a.step(p, x)
            q, mid, *_ = b.step(q, mid)
            r, last, *expected = c.step(r, mid)
            assert out == last and added == pytest.approx(expected)


def test_negation_report_and_target_in_any_order():
    g = toxicity.Grammar()
    total = lambda t: sum(g.clauses(t))
    w = toxicity.FIXED_WEIGHT
    assert total("i will kill you") == w > total("it was reported i will kill you") > total("i will not kill you") > 0
    assert total("you i will not kill") == total("i will not kill you") == pytest.approx(0.4 * w)
    assert total("idiot you are") == total("the idiot is you") == total("you idiot") == pytest.approx(1.5 * w) and total("idiot") == w
    assert total("not an idiot are you") == pytest.approx(0.4 * 1.5 * w)
    assert total("kill. you") == total("kill") == 0 and total("idiot. you") == w


def brute_clause(symbols, weights):
    """Weight of one clause from its symbols (o t n r i k), without automata."""
    total = 0.0
    places = {c: [i for i, s in enumerate(symbols) if s == c] for c in "tnrik"}
    for i in places["i"] + places["k"]:
        negated = any(i - 3 <= n < i for n in places["n"])
        factor = (0.4 if negated else 1.0) * (0.6 if any(r < i for r in places["r"]) else 1.0)
        before = any(t < i for t in places["t"])
        kind = symbols[i]
        after = not before and any(t > i and not any(i < j < t for j in places[kind]) for t in places["t"])
        if kind == "i":
            total += factor * weights[i] * (1.5 if before or after else 1.0)
        elif before or after:
            total += factor * weights[i]
    return total


def test_clauses_equal_a_brute_force_scorer():
    words = {"o": "plain", "t": "you", "n": "not", "r": "said", "k": "kill"}
    insults = {"grob": 2.0, "vile": 3.5, "zork": 1.25}
    g = toxicity.Grammar({f"={w}": x for w, x in insults.items()})
    rng = np.random.default_rng(4)
    for _ in range(400):
        symbols = list(rng.choice(list("oootnrik"), int(rng.integers(1, 14))))
        text = [words.get(s) or str(rng.choice(list(insults))) for s in symbols]
        expected = brute_clause(symbols, [insults.get(w, toxicity.FIXED_WEIGHT) for w in text])
        assert sum(g.clauses(" ".join(text))) == pytest.approx(expected), text


def test_very_long_text_is_scored_whole():
    g = toxicity.Grammar({"=grob": 2.0})
    assert g.clauses("plain word " * 100_000 + "you grob") == [3.0]


def test_grammar_learns_and_handles_odd_tables(spark):
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))  # noqa: E731  texts that are no near copies
    filler = lambda i: " ".join(f"q{letters(i)}{c}" for c in "abcdef")
    rows = [(i, filler(i) + (" you zork blarg" * 3 if i % 4 == 0 else " calm text with words")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(0, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "!!!")], DOCS).withColumn("toxic", F.lit(9))
    model = toxicity.learned(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, model).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(400)) and got[900] == got[901] == got[902] == 0
    assert toxicity.learned(docs, labels.limit(0)).patterns == {}
    assert toxicity.scored(docs.limit(0), model).count() == 0


# --- language ---


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    e, a = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    p, moves = langid.forward_backward(e, np.array([4]), a)
    weights = {path: math.exp(sum(e[t, 0, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:], strict=False))) for path in itertools.product(range(3), repeat=4)}
    z = sum(weights.values())
    for t in range(4):
        for y in range(3):
            assert p[t, 0, y] == pytest.approx(sum(w for path, w in weights.items() if path[t] == y) / z, rel=1e-6)
    expected = np.zeros((3, 3))
    for path, w in weights.items():
        for x, y in zip(path, path[1:], strict=False):
            expected[x, y] += w / z
    assert moves == pytest.approx(expected, rel=1e-6)


def test_sequences_in_a_batch_do_not_mix():
    rng = np.random.default_rng(4)
    e, a = rng.normal(size=(6, 3, 2)), rng.normal(size=(2, 2))
    length = np.array([6, 2, 4])
    p, _ = langid.forward_backward(e, length, a)
    for j, n in enumerate(length):
        alone, _ = langid.forward_backward(e[:n, j : j + 1], np.array([n]), a)
        assert p[:n, j] == pytest.approx(alone[:, 0], rel=1e-9)


def test_code_switched_words_and_odd_texts(spark):
    rng = np.random.default_rng(1)
    syllables = {"xx": ["ka", "lo", "mi", "ru"], "yy": ["sch", "ung", "eit", "ber"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(n))
    rows = [(i, make(lang, 40), lang) for i in range(200) for lang in [("xx", "yy")[i % 2]]]
    odd = [(900, None, "xx"), (901, "123 ½ ² !!", "yy"), (902, make("xx", 30), None), (903, make("xx", 5000), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit(5))
    model = langid.learned(docs.filter("doc_id < 150"))
    got = {r["doc_id"]: r for r in langid.labelled(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == got[903]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    spans = model.spans(make("xx", 8) + " " + make("yy", 8))
    assert [lang for _, lang in spans] == ["xx"] * 8 + ["yy"] * 8
    none = langid.learned(docs.limit(0))
    assert {r["lang_pred"] for r in langid.labelled(docs, none).collect()} == {"und"}


# --- language model ---


def brute_counts(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    c = Counter(w for _, t in rows if t is not False for w in words(t))
    return words, c


def test_base_scores_equal_brute_force_and_probabilities_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 20)  # so that the joined tail has rows
    rng = np.random.default_rng(6)
    vocabulary = [f"W{i}" for i in range(300)]
    rows = [(i, " ".join(vocabulary[int(x)] for x in np.minimum(rng.zipf(1.4, 60), 299))) for i in range(60)] + [(90, None), (91, ""), (92, "unseen Ünseen words W1")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1))
    got = {r["doc_id"]: r for r in lm.scored(docs, docs.filter("doc_id < 50")).collect()}
    words, c = brute_counts([r for r in rows if r[0] < 50])
    n, v = sum(c.values()), len(c)
    for i, text in rows:
        own = words(text)
        assert got[i]["n_tokens"] == len(own) and got[i]["n_known"] == sum(w in c for w in own) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert got[i]["score"] < 0
    assert lm.scored(docs.limit(0), docs).count() == 0
    assert lm.scored(docs, docs.limit(0)).count() == len(rows)


def test_scorer_is_normalised_and_nce_learns():
    share = np.full(lm.OUTPUTS, 1 / lm.OUTPUTS)
    w = lm.Weights.initial(share)
    target = np.tile(np.array([5, 9, 7]), 2000)
    one, two = lm.before(target)
    past = [np.full(s, 1e-4, dtype=np.float32) for s in lm.Weights.shapes()]
    rng = np.random.default_rng(0)
    start = lm.Scorer(w)(target)
    for s in range(0, 6000, lm.BATCH):
        noise = rng.integers(0, lm.OUTPUTS, lm.NOISE)
        lm.nce_step(w, past, target[s : s + lm.BATCH], one[s : s + lm.BATCH], two[s : s + lm.BATCH], noise, np.log(share).astype(np.float32), lm.RATE)
    own = lm.Scorer(w)
    assert own(target) > start
    total = sum(np.exp(own.b[o] + own.m1[o, 5] + own.m2[o, 7] - own.z[5, 7]) for o in range(lm.OUTPUTS))
    assert total == pytest.approx(1.0, rel=1e-3)


def test_every_position_is_a_training_target_once(spark, monkeypatch, tmp_path):
    def noted(state, share, chunks, seed):
        with open(tmp_path / f"{os.getpid()}", "a") as out:
            out.write("".join(f"{t} " for c in chunks for t in c[2:].tolist()))
        return sum(len(c) - 2 for c in chunks), state

    seen = []
    monkeypatch.setattr(lm, "nce_step", lambda w, past, target, *_: seen.extend(target.tolist()))
    share = np.full(lm.OUTPUTS, 1 / lm.OUTPUTS)
    flat = lm.Weights.initial(share).flat()
    chunks = [np.arange(n, dtype="<i2") for n in (700, 5, 3)]
    lm.train_shard(np.concatenate([flat, flat]), share, chunks, [0, 0])
    assert sorted(seen) == sorted(t for c in chunks for t in c[2:].tolist())
    # and over all rounds and shards every chunk is passed on once
    monkeypatch.setattr(lm, "train_shard", noted)
    texts = [" ".join(f"w{i}x{j}" for j in range(i)) for i in range(12)]
    train = docs_of(spark, texts)
    lm.learned(train, lm.written(lm.vocabulary(train), "test"))
    got = Counter(int(x) for f in tmp_path.iterdir() for x in f.read_text().split())
    assert sum(got.values()) == sum(len(lm.tokens_of(t)) for t in texts)
    assert max(Counter(got).values()) == len(texts)  # the end of each text; every other word occurs once


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 200)  # several shards on a small table
    docs = spark.range(60).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 30), i -> concat('w', (id * i) % 17))) as text")
    scores = []
    for n in (1, 5):
        spread = docs.repartition(n)
        scores.append({r["doc_id"]: r["score"] for r in lm.scored(spread, spread).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-6)


def test_long_texts_are_learned_from_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 5)
    docs = spark.createDataFrame([(1, " ".join("abcdefghijkl")), (None, "x y"), (2, None)], "doc_id long, text string")
    words = [lm.END, *[c.encode() for c in "abcdefghijkl"]]
    got = [list(map(int, __import__("numpy").frombuffer(r["ids"], dtype="<i2"))) for r in lm.coded(docs, words).collect()]
    whole = [lm.OUTPUTS, lm.OUTPUTS, *range(1, 13), 0]
    assert [whole[s : s + 7] for s in (0, 5, 10)] == sorted((g for g in got if len(g) > 3 and set(g) <= set(whole)), key=lambda g: whole.index(g[-1]) or 99)
    assert sorted(len(g) - 2 for g in got) == [1, 3, 3, 5, 5]


def test_class_column_is_class_of(spark):
    tokens = [b"a", b"ab", b"xyz\xc3\xa9", b"\n"]
    frame = spark.createDataFrame([(bytearray(t),) for t in tokens], "t binary")
    assert [r["k"] for r in frame.select(lm.class_column(F.col("t")).alias("k")).collect()] == [lm.class_of(t) for t in tokens]


# --- quality ---


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
    lines, dup, before = (text or "").split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_text_stats_equal_brute_force():
    texts = [None, "", " \t\n", "a b c a b c", "é ü\u00a0x # $$\x1cq", "l\nl\n\nl \nl", "x " * 100, "😀 a<b>|c&d%"]
    rng = np.random.default_rng(8)
    texts += ["".join(rng.choice(list("ab \n#é\x0b"), 200)) for _ in range(50)]
    for t in texts:
        assert quality.text_stats(t) == brute_stats(t)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "good", good + str(i)) for i in range(40)] + [(100 + i, "bad", "x" if i % 10 else good) for i in range(40)] + [(200, "tiny", good), (201, None, None), (201, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("kept", F.lit(1))
    got = [(r["doc_id"], r["kept"], r["base_failed"]) for r in quality.judged(docs).collect()]
    assert len(got) == len(rows)
    kept = {d for d, k, _ in got if k}
    assert kept == set(range(40)) | {200}
    assert quality.judged(docs.limit(0)).count() == 0


def test_soft_rules_are_decided_by_the_host(spark):
    """A document of symbols goes where the host's rate stands out, and stays where it does not."""
    prose = " ".join(f"w{i}" for i in range(80))
    table = " ".join(f"c{i}|" for i in range(80))
    rows = [(1000 * h + i, f"host{h}", (table if i < (12 if h == 7 else 2) else prose) + f" n{i}") for h in range(12) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r["doc_id"]: r["kept"] for r in quality.judged(docs).collect()}
    assert {i for i, k in got.items() if not k} == {7000 + i for i in range(12)}
    assert all(r["kept"] for r in quality.judged(docs, level=50.0).collect())


# --- SimHash ---


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_golay_keys():
    for text in [None, "", "A b", "one TWO three", "a b c d e f", "x " * 50]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert len(np.unique(simhash.golay_leaders())) == 2048  # the code is perfect
    rng = np.random.default_rng(9)
    fps = rng.integers(-(2**63), 2**63 - 1, 300)
    for bits in (0, 1, 2):
        other = fps.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.int64(-(2**63)) if b == 63 else np.int64(1) << np.int64(b)
        (ra, ka), (rb, kb) = simhash.fuzzy_keys(fps), simhash.fuzzy_keys(other)
        for i in range(len(fps)):
            assert set(ka[ra == i]) & set(kb[rb == i])


def reach(fps, most=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= most:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_links_give_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(10)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    fps += [fps[0] ^ (1 << int(b)) for b in range(40)]  # a crowded bucket
    for _ in range(30):  # a chain
        fps.append(fps[-1] ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))))
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = [(r["a"], r["b"]) for r in simhash.links(frame).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in edges)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    expected = reach(fps)
    least = {k: min(f for f, e in zip(fps, expected, strict=True) if e == k) for k in set(expected)}
    assert {f: roots.get(f, f) for f in fps} == {f: least[e] for f, e in zip(fps, expected, strict=True)}


def test_near_duplicate_components(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base.replace("word7 ", "other ")), (4, None), (8, ""), (7, "lonely text"), (3, base), (None, base), (None, "other text alone")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit("x"))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    comp = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    by_doc = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert by_doc[5] == by_doc[3] == 3 and by_doc[4] == by_doc[8] == 4 and by_doc[7] == 7
    assert [c for (d, _), c in comp.items() if d is None].count(None) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert near[9] == near[5] == 3 and near[4] == near[8] == 4 and near[7] == 7
    assert simhash.near_copies(docs.limit(0)).count() == 0


def test_near_copies_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    vocabulary = [f"v{i}" for i in range(5000)]
    texts = []
    for _ in range(25):
        words = [vocabulary[int(i)] for i in rng.integers(0, 5000, 150)]
        texts.append(words)
        for _ in range(int(rng.integers(0, 20))):
            other = words.copy()
            for _ in range(int(rng.integers(0, 6))):
                other[int(rng.integers(0, 150))] = vocabulary[int(rng.integers(0, 5000))]
            texts.append(other)
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) for w in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(spark, [" ".join(w) for w in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def near_roots(texts):
    """Least number of each text's component by all pairs of five-word runs at 0.8."""
    sets = [set(zip(*[w[i:] for i in range(5)], strict=False)) for w in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_found(spark, texts):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(spark, [" ".join(w) for w in texts])).collect()}
    return [got[i] for i in range(len(texts))]


def test_near_copies_that_differ_by_a_block(spark):
    rng = np.random.default_rng(21)
    new = lambda n: [f"v{min(int(x), 4999)}" for x in rng.zipf(1.3, n)]
    texts = []
    for n in (150, 600):
        for _ in range(20):
            words = new(n)
            part = n // 6
            texts += [words, words + new(part), words[: n - part], words[part:] + words[:part]]
    expected = near_roots(texts)
    assert sum(e != i for i, e in enumerate(expected)) > 80
    assert near_found(spark, texts) == expected


def test_near_copies_among_many_that_share_a_template(spark):
    rng = np.random.default_rng(22)
    new = lambda n: [f"v{int(x)}" for x in rng.integers(0, 50000, n)]
    frame = new(170)
    texts = [frame]
    for _ in range(40):  # below 0.8 to each other, but each has one near copy of its own
        own = new(32)
        texts += [frame + own, frame[2:] + own]
    chain = frame + new(40)
    for i in range(30):  # edits of edits: neighbours are alike, the ends are not
        chain = chain[:150] + new(4) + chain[154:] if i % 2 else new(5) + chain[5:]
        texts.append(chain)
    expected = near_roots(texts)
    assert len(set(expected)) > 1
    assert near_found(spark, texts) == expected


def test_near_copies_among_texts_of_the_same_words(spark):
    rng = np.random.default_rng(23)
    words = [f"v{i}" for i in range(200)]
    texts = []
    for _ in range(20):  # one set of words in many orders, each with a near copy
        own = [words[int(i)] for i in rng.permutation(200)]
        other = own.copy()
        other[100], other[101] = other[101], other[100]
        texts += [own, other]
    expected = near_roots(texts)
    assert expected == [i - i % 2 for i in range(40)]
    assert near_found(spark, texts) == expected


def test_parity_bits_never_exclude_a_similar_pair():
    rng = np.random.default_rng(6)
    for n in (5, 40, 300, 2000):
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for changed in (0, 1, n // 12, n // 5, n // 2):
            other = np.unique(np.concatenate([own[changed:], rng.integers(0, 2**63, changed).astype(np.uint64)]))
            differ = len(np.setxor1d(own, other))
            bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in simhash.parities(own) ^ simhash.parities(other))
            assert bits <= differ
            common = len(np.intersect1d(own, other))
            if common >= 0.8 * (len(own) + len(other) - common):
                assert bits <= 0.2 / 1.8 * (len(own) + len(other)) + 1e-9


def test_near_copies_in_crowded_runs(spark):
    """Hundreds of texts share their rarest runs, are below 0.8 to most others, and have a near copy each."""
    rng = np.random.default_rng(15)
    shared = [f"s{i}" for i in range(30)]
    texts = []
    for i in range(120):
        words = shared + [f"w{int(x)}" for x in rng.integers(0, 60, 20)]
        other = words.copy()
        other[-1 - int(rng.integers(0, 3))] = f"u{i}"
        texts += [words, other]
    assert near_found(spark, texts) == near_roots(texts)


def test_word_labels_of_code_switched_texts_go_through_the_transitions(spark):
    """Words that both languages have take the language around them; without transitions they switch at random."""
    rng = np.random.default_rng(21)
    own = {"aa": [f"bak{c}em" for c in "abcdefghij"], "bb": [f"zul{c}ot" for c in "abcdefghij"]}
    both = [f"mi{c}" for c in "abcdefghijklmnop"]
    draw = lambda lang, n: [str(rng.choice(own[lang] if rng.random() < 0.5 else both)) for _ in range(n)]
    rows = [(i, " ".join(draw(lang, 60)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    model = langid.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [(draw("aa", 15) + draw("bb", 10), 15) for _ in range(60)]
    loose = langid.Model(model.languages, model.weights, np.zeros_like(model.transition))
    texts = [" ".join(words) for words, _ in mixed]
    bound, free = model.read(texts), loose.read(texts)
    right = lambda m: np.mean([lab == ("aa" if i < cut else "bb") for words, cut in mixed for i, (_, lab) in enumerate(m.spans(" ".join(words)))])
    assert right(model) > 0.95 > right(loose)
    assert np.mean([r[2] for r in bound]) < 1.5 < np.mean([r[2] for r in free])
    assert all(r[0] == "aa" and r[3] == "bb" and 0.2 < r[4] < 0.6 for r in bound)
    twice = docs_of(spark, [*texts[:2], *texts[:2], None, "", "123"])
    found = {r["doc_id"]: tuple(r)[1:] for r in langid.labelled(twice, model).collect()}
    for i in (0, 1):  # scores differ in the last digits of single precision with the texts of a batch
        for own in (found[i], found[i + 2]):
            assert (own[0], *own[2:]) == (bound[i][0], *bound[i][2:]) and own[1] == pytest.approx(bound[i][1], abs=1e-6)
    assert found[4] == found[5] == found[6] == (langid.UNKNOWN, 0.0, 0, None, 0.0)
    assert langid.labelled(twice.limit(0), model).count() == 0


def prose(language: int, n: int, different: int = 2000) -> str:
    """n words of an invented language, of different ones as many as given."""
    return " ".join("".join(chr(97 + (language * 5 + w // 26**i + i) % 26) for i in range(3, -1, -1)) for w in (k * 7 % different for k in range(n)))


def test_learning_languages_leaves_texts_on_the_executors(spark):
    import tracemalloc

    rows = [(i, prose(i % 2, 20_000), "ab"[i % 2]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).localCheckpoint()
    tracemalloc.start()
    try:
        model = langid.learned(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.languages == ["a", "b"]
    assert most < 30e6  # gradients of a fixed size; the windows of these 400,000 words alone took more


def test_training_does_not_depend_on_chunks_or_partitions(spark, monkeypatch):
    rows = [(i, prose(i % 2, 40 + 30 * i), "ab"[i % 2]) for i in range(12)] + [(50, "one", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(docs.repartition(1))
    again = langid.learned(docs.repartition(3))
    assert model.weights.tobytes() == again.weights.tobytes() and model.transition.tobytes() == again.transition.tobytes()
    monkeypatch.setattr(langid, "CHUNK", 5)  # 13 documents, more than 100 windows
    split = langid.learned(docs)
    assert split.languages == model.languages == ["a", "b", "c"]
    np.testing.assert_allclose(split.weights, model.weights, rtol=0, atol=1e-6)
    np.testing.assert_allclose(split.transition, model.transition, rtol=0, atol=1e-6)
