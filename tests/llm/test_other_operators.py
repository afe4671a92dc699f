"""URL rules, decontamination, extraction, sharding, audio, token counts and packing against brute force."""

import html
import itertools
import random
import zlib

import numpy as np
import pytest
from compare import connection, difference
from conftest import SMALL

from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, html_extract, packing, queries, sharding, telephony, token_counts, url_reputation


# -- urls -------------------------------------------------------------------


def slow_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def slow_rule(host, path):
    fits = [(h + p, v) for h, p, v in url_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


URLS = [None, "", "nothing", "http://", "http://A.Example.NET/en/1", "https://example.net/de/5", "http://x.example.com/de/", "http://fr.org/fr/7?x=/", "http://org/fr/", "http://a.net", "http://a.net?x", "http://notexample.com/de/2", "x://É.org:80/fr/x#/y", "http://h.example.com/en/3\nz", "a://b://c/d"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], None)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(3, 0, 0), (3, 1, 0), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        got = {r["page_id"]: r for r in url_reputation.judge(pages, lab).collect() if r["page_id"] is not None}
        assert len(got) == len(URLS)
        for i, u in enumerate(URLS):
            host, path = slow_parts(u)
            rule, verdict = slow_rule(host, path)
            assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
            assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert url_reputation.judge(pages.limit(0), labels).count() == 0


def test_bad_hosts_are_blocked_by_the_bound(spark):
    pages = spark.createDataFrame([(i, f"http://bad.example.com/x/{i}") for i in range(200)] + [(1000 + i, f"http://good.other.com/x/{1000 + i}") for i in range(200)] + [(5000, "http://rare.third.com/x/5000")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(200)] + [(1000 + i, 1, 0) for i in range(200)] + [(5000, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_reputation.judge(pages, labels).collect()}
    assert all(got[i] == "block" for i in range(200)) and all(got[1000 + i] == "allow" for i in range(200)) and got[5000] == "allow"


def test_url_sql(spark):
    assert difference(queries.op3_url_reputation(spark, SMALL), connection(SMALL), queries.oracle_sql()["op3_url_reputation"]) == ""


def test_url_plan_is_native(spark):
    plan = url_reputation.judge(spark.read.parquet(f"{SMALL}/pages.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Join") < 10 and plan.count("Exchange") < 10


def test_domains_and_suffixes(spark):
    want = {
        "a.b.example.com": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.example.de:8080": ("example.de", "de"),
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""), "co.info": ("co.info", "info"),
    }
    domain, suffix = url_reputation.levels(F.col("host"))
    got = spark.createDataFrame([(h,) for h in want], "host string").select("host", domain, suffix).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == want


def test_rule_ties_long_urls_and_repeated_pages(spark):
    long = "http://h.org/fr/" + "x" * 200_000
    pages = spark.createDataFrame([(1, "http://a.b/c/1"), (1, "http://a.b/c/1"), (2, long)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = [("b", "/c/", "block"), ("a.b", "/", "allow"), ("b", "/c/", "allow"), ("org", "/fr/", "allow")]
    got = sorted(url_reputation.judge(pages, labels, rules).select("page_id", "rule", "verdict", F.length("path")).collect())
    assert [tuple(r) for r in got] == [(1, "a.b/", "allow", 4), (1, "a.b/", "allow", 4), (2, "org/fr/", "allow", len(long) - 12)]


def test_large_lookup_tables_are_joined_by_spread_keys(spark, monkeypatch):
    pages, labels = spark.read.parquet(f"{SMALL}/pages.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    want = sorted(url_reputation.judge(pages, labels).collect())
    monkeypatch.setattr(url_reputation, "BROADCAST_BYTES", -1)
    assert sorted(url_reputation.judge(pages, labels).collect()) == want


# -- decontamination --------------------------------------------------------


def test_every_pair_of_substitutions_leaves_a_hit():
    for errors in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(all(o + d not in errors for d in m) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1])), errors


@pytest.mark.parametrize("n", range(1, 13))
def test_masks_of_short_items_avoid_their_substitutions(n):
    for errors in itertools.combinations(range(n), n // 5):
        assert any(not set(m) & set(errors) for m in decontaminate.short_masks(n)), errors


def test_hot_hashes_are_expanded_in_steps(monkeypatch):
    from quillgraph.llm import textvec
    import pyarrow as pa

    index = decontaminate.Index(list(range(40)), ["same words in every item of this benchmark here and so on and on"] * 40)
    text = textvec.utf8(pa.array(["same words in every item of this benchmark here and so on and on " * 20]))
    want = index.overlaps(*text)
    monkeypatch.setattr(decontaminate, "STEP", 7)
    assert index.overlaps(*text) == want and len(want[0]) == 40


def words_of(text):
    import re

    return [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]


def slow_overlap(doc, item):
    d, t = words_of(doc), words_of(item)
    n = len(t)
    if not n:
        return False
    w = min(decontaminate.WINDOW, n)
    need = w - w // 5
    return any(sum(d[i + k] == t[j + k] for k in range(w)) >= need for i in range(len(d) - w + 1) for j in range(n - w + 1))


def test_decontamination_against_all_alignments(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(40)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [" ".join(say(n)) for n in (30, 20, 13, 9, 5, 3, 50, 12, 7, 2)] + [None, "", ", "]
    docs = []
    for i in range(150):
        d = say(r.randint(0, 60))
        if i % 2:
            t = (items[r.randrange(10)] or "").split()
            t = t[r.randint(0, max(0, len(t) - 13)) :][: r.randint(8, 40)]
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = "changed"
            at = r.randint(0, len(d))
            d[at:at] = t
        docs.append("  ".join(d).upper() if i % 5 == 0 else ", ".join(d))
    docs += [None, "", items[0], "x " * 30_000 + items[1]]  # the last is too long for the slow comparison: its tail is compared
    bench = spark.createDataFrame([(i, t, "e") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(i, d, "z") for i, d in enumerate(docs)], "doc_id long, text string, item_id string")
    want = sorted((i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if slow_overlap((d or "")[-1000:] if i == len(docs) - 1 else d, t))
    found = decontaminate.contaminated(df, bench)
    assert sorted((x["doc_id"], x["item_id"]) for x in found.collect()) == want
    split = [decontaminate.contaminated(df, bench.where(f"item_id % 3 = {k}")) for k in range(3)]
    assert sorted((x["doc_id"], x["item_id"]) for s in split for x in s.collect()) == want
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == set(range(len(docs))) - {i for i, j in want if len(words_of(items[j])) >= decontaminate.EVIDENCE}
    assert sorted(x["doc_id"] for x in decontaminate.contaminated(df.where("doc_id = 152").unionByName(df.where("doc_id = 152")), bench.where("item_id = 0")).collect()) == [152, 152]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_index_blocks_hold_every_item(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    ids = sorted(i for index in decontaminate.indexes(bench, block_bytes=2000) for i in index.ids.tolist())
    assert ids == sorted(r["item_id"] for r in bench.collect())


# -- html -------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("no markup at all, but a sentence that goes on for a while.", None),
        ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First   text\nhere &eacute;.<br>More<p>Second one<script>var p='</p>';</script></article><div class=ad>Buy</div><footer>&copy; us</footer>", "A & B\n\nFirst text here é. More\n\nSecond one"),
        ("<article><p>Only this.</p><!-- <p>not this</p> --><section class='comments'><h3>Comments</h3><div class=comment><p>Nice post, thank you.</p></div></section></article>", "Only this."),
        ("<p>unclosed <b>bold <i>it", None),
        ("<<<>>> <a <b", None),
    ],
)
def test_pages(page, want):
    got = html_extract.main_text(page, html_extract.fit())
    assert isinstance(got, str) and (want is None or got == want)


@pytest.mark.parametrize("inside,want", [(x, "first  last") for x in ("</3 b>", "</ p>", "</>", "</β>", "<select>", "<select/>", "<object data=x />", "<iframe/>", "<video src=x>", "<audio>", "<canvas>", "<template>", "<noscript>", "<math/>", "<select><option>One</select>", "<video><video>no</video>")]
    + [(f"{x} ", f"first {x} last") for x in ("<β", "<é", "<日", "< 3", "<3")] + [("<math><mi>x</mi><annotation>tex</annotation></math>", "first x last"), ("<object>shown</object>", "first shown last"), ("<script>", "first")])
def test_markup_does_not_end_a_page(inside, want):
    found, todo = [], [html_extract.parse(f"<article><p>first {inside} last</p><p>next</p></article>")]
    while todo:
        x = todo.pop()
        todo.extend(reversed(x.children))
        found += x.parts
    if inside != "<script>":
        want += " next"
    assert " ".join(" ".join(found).split()) == " ".join(want.split())


WHOLE = html_extract.Model(html_extract.Words(np.zeros(html_extract.WORD_PLACES), np.full(html_extract.WORD_PLACES, -1)), html_extract.trees.Boosted(1, 1.0))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>Energy is <math><mi>E</mi></math> here</p>", "Energy is E here"),
        ("<p>one <object>two</object> <custom-tag>three</custom-tag> four<input name=q> five</p>", "one two three four five"),
        ("<p>a<noscript> b</noscript> c</p><noscript>own block</noscript>", "a b c\n\nown block"),
        ("<p>a<script>x</script>b<style>y</style> <select><option>o</select>c<button>Ok</button></p>", "ab c"),
        ("<p>&am<!-- c -->p; &amp;lt; &eacute;&#x41;&nbsp;&nbsp;z</p>", "&amp; &lt; éA z"),
        ("<p>one</div> still one</p><p>two", "one still one\n\ntwo"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("x<hr>y<br>z<h4>t</h4>u", "x\n\ny z\n\nt\n\nu"),
        ("<p> \n</p><div></div>", ""),
    ],
)
def test_blocks_of_a_page_with_a_model_that_keeps_all(page, want):
    assert html_extract.main_text(page, WHOLE) == want


def test_very_long_and_repeated_pages(spark):
    page = "<article>" + "<p>A paragraph of a very long page, with words.</p>" * 60_000 + "</article>"
    df = spark.createDataFrame([(1, "u", page, 0), (2, "v", "<article><p>Same.</p></article>", 0), (2, "v", "<article><p>Same.</p></article>", 0)], "page_id long, url string, html string, n_chars int")
    rows = html_extract.extract(df, WHOLE).collect()
    assert sorted(r["n_chars"] for r in rows) == [5, 5, 60_000 * 46 - 2]


def test_any_attribute_word_counts():
    """A word that no list names tells nodes apart once it was seen in training."""
    words = html_extract._words(' class="zorble" id=x-quux role=note')
    assert len(words) == len(set(words)) >= 3 and html_extract._words(' data-x="a"') == ()


def test_generated_pages_and_hierarchy():
    r, model = random.Random(77), html_extract.fit()
    hit = extra = missed = 0
    for _ in range(120):
        page = html_extract.training_page(r)
        want, todo = [], [html_extract.parse(page)]
        while todo:
            x = todo.pop()
            todo.extend(reversed(x.children))
            if x.parts and html_extract.GOOD in x.parts[0]:
                want.append(x.parts[0].replace(html_extract.GOOD, ""))
        got = html_extract.main_text(page.replace(html_extract.GOOD, ""), model).split("\n\n")
        hit += len(set(got) & set(want))
        extra += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert hit / (hit + missed) > 0.97 and hit / (hit + extra) > 0.95


def test_choice_is_the_best_of_all():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = 9
        parent = np.array([-1] + [int(r.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds = r.normal(size=n)
        best = max((sum(odds[i] for i in range(1, n) if keep[i - 1]), keep) for keep in itertools.product((0, 1), repeat=n - 1) if all(not keep[i - 1] or parent[i] == 0 or keep[parent[i] - 1] for i in range(1, n)))
        got = html_extract.choose(parent, depth, odds)
        assert abs(sum(odds[1:][got[1:]]) - best[0]) < 1e-9


def test_extract_rows(spark):
    deep = "<div>" * 3000 + "<p>deep text stands here.</p>"
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, None, "", "t"), (None, "v", deep, None), (2, "w", "<article><p>" + html.escape("a<b " * 50_000) + "</p></article>", "t")], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r["url"]: r for r in got.collect()}
    assert rows["u"]["text"] == "" and rows["w"]["n_chars"] == len(("a<b " * 50_000).strip()) and len(rows) == 4
    assert html_extract.extract(pages.limit(0)).count() == 0


# -- sharding ---------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 1025])
def test_permutation(n):
    assert sorted(sharding.permute(np.arange(n), n).tolist()) == list(range(n))
    if n > 100:
        assert sharding.permute(np.arange(n), n).tolist() != sharding.permute(np.arange(n), n, seed=1).tolist()


def test_shards(spark):
    rows = [(i % 97, f"text {i % 13}" if i % 7 else None, "s") for i in range(333)] + [(None, "", "t")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.shard(df).collect()
    counts = {}
    for r in out:
        counts.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(counts) == list(range(16)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sorted(r["row_number"] for r in out) == list(range(533))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == want
    again = sharding.shard(df.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, out), key=repr)
    assert sharding.shard(df.limit(0)).count() == 0


# -- audio ------------------------------------------------------------------


def test_tables():
    u, a = telephony.TABLES["mulaw"], telephony.TABLES["alaw"]
    assert (u[0x00], u[0x7F], u[0x80], u[0xFF], u[0x8F]) == (-32124, 0, 32124, 0, 16764)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA], a[0x80]) == (-8, 8, -32256, 32256, 5504)


def slow_ima(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.IMA_STEP[index])
            move = step >> 3
            move += step if code & 4 else 0
            move += step >> 1 if code & 2 else 0
            move += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(telephony.IMA_INDEX[code & 7])))
            out.append(value)
    return out


def test_ima_blocks():
    blocks = np.random.default_rng(1).integers(0, 256, (20, 64)).astype(np.uint8)
    assert telephony.decode_ima(blocks).tolist() == [slow_ima(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm", "pcm"])
def test_wav_round_trip(codec):
    data = bytes(range(256)) * 2
    file = telephony.wav(data, codec)
    assert telephony.unwav(file)[0] == codec and bytes(telephony.unwav(file)[2]) == data
    assert telephony.decode(file).dtype == np.int16


def test_media_rows(spark):
    import hashlib

    texts = [None, "", "a", "x" * 64, "é" * 5000, "x" * 64]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in telephony.media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * ((-len(raw)) % 64 or (64 if not raw else 0))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert bytes(telephony.unwav(bytes(r["media"]))[2]) == pad and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
        samples = telephony.TABLES["mulaw"][np.frombuffer(pad, np.uint8)]
        wide = np.frombuffer(r["pcm_16k"], np.int16)
        assert (wide[0::2] == samples).all() and wide[-1] == samples[-1]
    assert got[3]["feature"] == got[5]["feature"] and got[0]["feature"] == got[1]["feature"]
    assert telephony.media(df.limit(0)).count() == 0


def test_media_table_holds_the_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    out = telephony.media(df, str(tmp_path / "media"), keep_media=False, keep_pcm=False)
    files = [(r["doc_id"], bytes(r["media"])) for r in spark.read.parquet(str(tmp_path / "media")).collect()]
    assert sorted(files) == sorted([(1, telephony.wav(b"a" + bytes(63)))] * 2 + [(2, telephony.wav(bytes(64)))])
    assert all(r["media"] is None and r["pcm_16k"] is None for r in out.collect()) and out.count() == 3


def test_long_payloads_are_decoded_in_segments(monkeypatch):
    data = memoryview(np.random.default_rng(2).integers(0, 256, 64 * 50).astype(np.uint8).tobytes())
    want = telephony.features([data], keep_pcm=True)
    monkeypatch.setattr(telephony, "SEGMENT", 64 * 8)
    assert telephony.features([data], keep_pcm=True) == want


def test_very_long_text(spark):
    import hashlib

    text = "word " * 10_000_000  # 50 MB
    got = telephony.media(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep_media=False, keep_pcm=False).collect()
    assert [(r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) for r in got] == [(len(text), -(-len(text) // 64) * 64, hashlib.sha256(telephony.payload(text.encode())).hexdigest())]


# -- token counts -----------------------------------------------------------


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    r = random.Random(8)
    signs = ["a", "B", "é", "  ", "\n", " ", "\t", "\u00a0", "\u2003", "\x1c", "12", "!", "'s", "<|endoftext|>", "中", "🙂", "\r\n", "ñ", "\u0301"]
    texts = [None, "", " ", "<|endoftext|> <|endoftext|>", "word " * 20_000] + ["".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {x["doc_id"]: x for x in token_counts.token_counts(df, path).collect()}
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", add_special_tokens=False))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512), repr(t)
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {x["doc_id"]: len(own.encode(x["text"], add_special_tokens=False)) for x in real.collect()}
    assert {x["doc_id"]: x["n_tokens"] for x in token_counts.token_counts(real, path).collect()} == want


# -- packing ----------------------------------------------------------------


def test_bounds_are_optimal():
    r = random.Random(3)
    for _ in range(30):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 8))))
        counts = np.array([r.randint(1, 20) for _ in lengths])
        for k in (1, 2, 3):
            cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))  # noqa: B023, E731
            best = min(cost([*c, lengths[-1]]) for c in itertools.combinations(lengths.tolist(), min(k, len(lengths)) - 1))
            assert cost(packing.best_bounds(lengths, counts, k)) == best


def test_packs(spark):
    r = random.Random(6)
    texts = [" ".join("w" * 1 for _ in range(r.choice((1, 5, 90, 700, 5000)) + r.randint(0, 9))) for _ in range(300)] + [None, "", " \n", "x " * 60_000]
    df = spark.createDataFrame([(i % 250, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, batch int")
    out = packing.pack(df, buckets=4, token_budget=2000)
    rows = out.collect()
    assert sorted(((x["doc_id"], x["n_tokens"]) for x in rows)) == sorted((i % 250, len((t or "").split())) for i, t in enumerate(texts))
    seen = {}
    for x in rows:
        assert x["padding"] == x["bucket_len"] - x["n_tokens"] >= 0
        seen.setdefault((x["bucket"], x["batch"]), []).append((x["slot"], x["bucket_len"]))
    for batch in seen.values():
        assert sorted(s for s, _ in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0][1] <= 2000
    full = {}
    for (b, n), batch in seen.items():
        full.setdefault(b, {})[n] = len(batch)
    for sizes in full.values():  # all batches of a bucket but its last are as full as can be
        assert sorted(sizes) == list(range(len(sizes))) and len({sizes[n] for n in range(len(sizes) - 1)}) <= 1
    assert packing.pack(df.limit(0)).count() == 0


def test_bounds_over_many_long_lengths():
    """Lengths far over 2048 have bins of their own: the bounds are those of the slow program."""
    r = random.Random(4)
    lengths = np.array(sorted(r.sample(range(1, 300_000), 120)))
    counts = np.array([r.randint(1, 9) for _ in lengths])
    m, total = len(lengths), np.concatenate([[0], np.cumsum(counts)])
    best = np.where(np.arange(m + 1) == 0, 0, np.inf)
    for _ in range(6):
        best = np.array([np.inf] + [min(best[i] + int(lengths[j - 1]) * int(total[j] - total[i]) for i in range(j)) for j in range(1, m + 1)])
    bounds = packing.best_bounds(lengths, counts, 6)
    assert sum(int(n) * min(b for b in bounds if b >= x) for x, n in zip(lengths.tolist(), counts, strict=True)) == best[-1]


def test_token_lengths_and_rows_over_the_budget(spark):
    df = spark.createDataFrame([(i, "ab " * n) for i, n in enumerate((1, 2, 50, 50))], "doc_id long, text string")
    rows = packing.pack(df, buckets=2, token_budget=60, length=lambda text: F.length(text).cast("long")).collect()
    assert sorted((x["n_tokens"], x["over_budget"]) for x in rows) == [(3, False), (6, False), (150, True), (150, True)]
    assert len({(x["bucket"], x["batch"]) for x in rows if x["over_budget"]}) == 2


def test_batches_of_the_library_are_balanced_by_bytes():
    sizes = np.array([5, 5, 5, 40, 1, 1, 9, 9])
    got = list(token_counts.balanced(sizes, 12))
    assert [r for a, b in got for r in range(a, b)] == list(range(8))
    assert all(sizes[a:b].sum() <= 12 or b - a == 1 for a, b in got) and got == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)]


def test_texts_are_cut_only_where_the_file_allows_it():
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    file = json.loads(Tokenizer.from_file(path).to_str())
    assert token_counts.cuttable(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [file["added_tokens"][0] | {"content": "<a b>"}]}, {"model": {"type": "WordPiece"}}):
        assert not token_counts.cuttable(file | change), change
    whole = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["A b  C", "", "x\n y <|endoftext|> z"]
    import pyarrow as pa

    from quillgraph.llm import textvec

    assert not whole.cut and whole.count(*textvec.utf8(pa.array(texts))).tolist() == [len(own.encode(t, add_special_tokens=False)) for t in texts]


def test_token_counts_of_repeated_rows_empty_tables_and_forgetting(spark, monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillgraph.llm import textvec

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, 5)], "doc_id long, text string, _text int")
    assert sorted(x["n_tokens"] for x in token_counts.token_counts(df, path).collect()) == [0, 2, 2]
    assert token_counts.token_counts(df.limit(0), path).count() == 0
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "TOGETHER", 30)
    r = random.Random(1)
    texts = [" ".join(f"{r.choice('abc')}{r.randint(0, 99)}" for _ in range(40)) for _ in range(60)]
    own = Tokenizer.from_file(path)
    assert token_counts.Counter(path).count(*textvec.utf8(pa.array(texts))).tolist() == [len(own.encode(t, add_special_tokens=False)) for t in texts]


def test_memory_of_counting_does_not_follow_the_batch():
    """Four times the texts in a batch need no more memory beside it."""
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    from quillgraph.llm import textvec

    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(2)
    texts = [" ".join(r.choices("abcdefgh", k=2000)) for _ in range(600)]
    counter.count(*textvec.utf8(pa.array(texts)))
    peaks = []
    for n in (1, 4):
        batch = textvec.utf8(pa.array(texts * n + [None, ""]))
        tracemalloc.start()
        counts = counter.count(*batch)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert counts.tolist() == counts[:600].tolist() * n + [0, 0]
    assert peaks[1] < 1.2 * peaks[0]


def test_memory_of_counting_is_a_few_times_what_is_cut_together():
    """The pipeline's packing stage took an executor over its limit: hashing all short pieces at once needed over 40 bytes a byte of text."""
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from quillgraph.llm import textvec

    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(3)
    texts = [" ".join(r.choices(["alpha", "beta", "gamma-delta", "é", "x1"], k=3000)) for _ in range(120)]
    batch = textvec.utf8(pa.array(texts))
    counter = token_counts.Counter(path)
    first = counter.count(*batch)
    tracemalloc.start()
    again = counter.count(*batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * min(token_counts.TEXT_BYTES, len(batch[0]))
    own = Tokenizer.from_file(path)
    assert first.tolist() == again.tolist()
    assert first[:5].tolist() == [len(own.encode(t, add_special_tokens=False)) for t in texts[:5]]
