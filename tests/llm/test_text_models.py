import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from cuelake.llm import chat, html_blocks, html_extract, html_pages, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- extraction


def test_field_on_pages_held_out():
    field = html_extract.default_field()
    right = total = 0
    for blocks, title, labels in html_pages.labelled_pages(150, seed=99):
        right += int((field.decode(html_extract.features(blocks, title)) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    field = html_extract.Field(r.normal(size=(3, 2)), r.normal(size=(2, 2)))
    x = r.normal(size=(7, 3))
    u = x @ field.weights
    cost = lambda y: sum(u[k, y[k]] for k in range(7)) + sum(field.moves[y[k], y[k + 1]] for k in range(6))
    best = max(([k >> b & 1 for b in range(7)] for k in range(128)), key=cost)
    assert field.decode(x).tolist() == best


def test_pages_without_and_with_clutter(spark):
    article = "<article><h1>Some news &amp; more</h1><p>First   paragraph\n of the article, with a good many words.<p>Second&nbsp;one, which is long enough as well.</article>"
    rows = [
        (1, "u", f"<title>Some news & more</title><nav><a href=x>Home</a></nav><div class='ad'>Buy it now, it is very good.</div>{article}<section class=comments><p>I liked this article a lot, it was good.</p></section><footer>&copy; us</footer><script>var a='<p>no</p>'</script>"),
        (2, "u", None), (2, "u", ""), (None, None, "<p>"), (3, "u", "<!-- open <p>x</p>"), (4, "u", "<div>" * 3000 + "deep"), (5, "u", "< 5 <<< <p"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["Some news & more\nFirst paragraph of the article, with a good many words.\nSecond one, which is long enough as well."]
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", "", ""]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_blocks():
    b = html_blocks.leaf_blocks("<ul class='side-menu'><li>a<li><a href=x>b c</a></ul><table><tr><td>1<td>2</table>t<textarea><p>x</textarea>")
    assert [(x.text, x.tag) for x in b] == [("a", "li"), ("b c", "li"), ("1", "td"), ("2", "td"), ("t", "body")]
    assert b[0].bits & html_blocks.BITS["is_nav"] and b[1].links == 3 and not b[4].bits


# --- quality


def brute_counts(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, inside = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            inside |= {k, k + 1, k + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n, rep = len(w), len(inside)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_counts_against_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(("a", "b", "cé", "d#", "E!")) + r.choice(("", "\n", "\t")) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 60, 400)]
    texts += [None, "", " \n \n", "x\nx\n\nx ", "a b c a b c", "ha " * 3000, "word" * 40_000, "\x0b\x0c\r", "\xa0  "]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a"), (0, "again")], "doc_id long, text string").withColumns({"s": F.lit(1), "f": F.lit("x"), "kept": F.lit(0)})
    got = {r.doc_id: tuple(r)[1:7] + (r.kept,) for r in quality_rules.judge(df, quality_rules.DecisionList()).orderBy(F.length("text") if False else "doc_id").collect() if r.doc_id}
    for k, t in enumerate(texts):
        if k:
            n, chars, symbols, dup, rep, failed = brute_counts(t)
            assert got[k] == (n, chars, symbols, dup, rep, failed, not failed), k
    assert quality_rules.judge(df.limit(0), quality_rules.DecisionList()).count() == 0
    assert quality_rules.keep_good(df, quality_rules.DecisionList()).columns == df.columns


def test_rules_are_learned_and_ordered(spark, sf_dir):
    x = np.zeros((1500, len(quality_rules.FEATURES)))
    r = np.random.default_rng(0)
    x[:, 2], x[:, 5] = r.random(1500), r.random(1500)
    bad = (x[:, 2] > 0.8) | ((x[:, 5] > 0.9) & (x[:, 2] < 0.5))
    rules = quality_rules.learn(x, bad)
    assert 1 < len(rules.rules) <= 6 and (rules.rejects(x) == bad).mean() > 0.97
    assert quality_rules.learn(x, np.zeros(1500, bool)).rules == [] and quality_rules.learn(x[:0], bad[:0]).rules == []
    assert "CASE WHEN" in str(rules.keeps())
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    fitted = quality_rules.fit(docs, labels)
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality_rules.judge(docs, fitted).collect()}
    good = [kept[r.doc_id][0] for r in labels.where("quality = 1").collect() if not kept[r.doc_id][1]]
    junk = [kept[r.doc_id][0] for r in labels.where("quality = 0").collect()]
    assert sum(good) / len(good) > 0.95 and sum(junk) / len(junk) < 0.3
    plan = quality_rules.judge(docs, fitted)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert quality_rules.fit(docs, labels.limit(0)).rules == []


# --- toxicity


def test_folding():
    assert toxicity.fold("Idi0t!") == toxicity.fold("idiot ") == " idiot  "
    assert toxicity.fold("іdіоt").strip() == "idiot" and toxicity.fold("ｉdiot").strip() == "idiot" and toxicity.fold("ïdıöt").strip() == "idiot"
    assert toxicity.fold("st​up1d").strip() == "stupid" and toxicity.fold("l0$er").split() == toxicity.fold("loser").split() and toxicity.fold("stupid$$$").split() == ["stupid"]
    assert toxicity.fold(None).strip() == ""


def labelled(spark, n=600):
    r = random.Random(1)
    base = ["able", "bear", "cold", "dune", "east", "frog", "gold", "hill", "iron", "jade"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(base) for _ in range(r.randint(40, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(("stupid", "moron", "stup1d"))
        elif i % 16 == 1:
            at = r.randrange(len(w) - 1)
            w[at : at + 2] = ["moron", "bay"]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_lexicon_with_exceptions_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    lex = toxicity.fit(docs, labels)
    assert " moron bay" in lex.patterns and lex.weights[lex.patterns.index(" moron bay")] == 0
    rows = {r.doc_id: r.score for r in toxicity.score(docs, lex).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((rows[i] >= 0.7) == (i % 4 == 0) for i in held) / len(held) > 0.95
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, flipped) == lex
    edge = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 200_000), (2, "moron " * 60)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = toxicity.score(edge, lex).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and toxicity.score(edge.limit(0), lex).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert none.patterns == () and toxicity.score(docs, none).where("score >= 0.7").count() == 0


# --- chat


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_conversations_read_back(spark):
    r = random.Random(2)
    odd = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "\\", "\\\\<\\s>", "<<SYS>>x<</SYS>>", "[\\INST]", "é\n" * 5, "", None, "x" * 3000, "<|", "a<", "[", "|>\n", "<eos><unk>"]
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], r.choice(odd) or None) for c in range(30) for t in range(r.randint(1, 12))]
    rows += [(40, 0, None, "x"), (40, None, "to|ol>", None), (41, 0, "system", "only"), (42, 5, "assistant", "same"), (42, 5, "assistant", "same"), (None, 0, "user", "?"), (43, 0, "assistant", "long " * 50_000), (43, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"all": F.lit(1), "own": F.lit("x")})
    wins = chat.windows(df)
    turns = defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((t is not None, t or 0, role or "", text or ""))
    back = {x.conv_id: x for x in chat.read_back(wins).collect()}
    assert set(back) == set(turns)
    for c, ts in turns.items():
        ts = sorted(ts)
        assert [(a, b) for a, b in back[c].turns] == [(role, text) for _, _, role, text in ts], c
        assert back[c].loss_text == "".join(text for _, _, role, text in ts if role == "assistant"), c
    most = {c: max(len(x[3].encode()) / 4 + 5 for x in ts) for c, ts in turns.items()}
    for w in wins.collect():
        assert w.n_tokens <= chat.BUDGET or most[w.conv_id] > 200
        assert w.n_repeated <= chat.HISTORY_TURNS + 1
        for s in w.loss:
            assert w.formatted[s.start + s.length :].startswith("<|end|>")
    many = [w for w in wins.where("conv_id = 0").orderBy("window_no").collect()]
    assert all(w.formatted.startswith("<|system|>") for w in many)
    assert chat.windows(df.limit(0)).count() == 0
    assert "Python" not in wins._jdf.queryExecution().toString()


def test_prefix_sums_of_long_arrays(spark):
    df = spark.range(1).select(F.sequence(F.lit(1).cast("long"), F.lit(1000).cast("long")).alias("v"))
    assert df.select(chat._prefix(F.col("v")).alias("p")).first().p == np.cumsum(range(1, 1001)).tolist()


def test_unclosed_markup_costs_its_length():
    """Every end tag without a start would else walk all that is open; this page would take half an hour."""
    from cuelake.llm.html_blocks import leaf_blocks

    n = 200_000
    blocks = leaf_blocks("<div>" * n + "</p>" * n + "<p>text</p>" + "</div>" * n + "<p>more")
    assert [(b.text, b.tag) for b in blocks] == [("text", "p"), ("more", "p")]
