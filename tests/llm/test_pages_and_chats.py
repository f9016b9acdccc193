"""WARC archives, URL rules, HTML extraction and chat formatting."""

import hashlib
import json
import random
import re
import tempfile

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import chat, htmltext, queries, urlfilter, warc

PAGES = "page_id long, url string, html string, digest string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


LONG = "<p>é" + "long " * 40


def test_archives_round_trip(spark):
    rows = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (0, "http://a/0", "x"), (3, None, "x"), (4, "http://a/\r\n4", None), (5, "u", LONG + "!"), (None, "n", LONG), (1, "again", LONG)]
    got = sorted((tuple(r) for r in warc.archive_and_read(pages(spark, rows)).collect()), key=str)
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), digest(h), "revisit" if i == 2 else "response", 1 if i == 2 else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
    assert warc.archive_and_read(pages(spark, [])).count() == 0


def test_the_sums_of_a_hot_payload_are_a_table(spark):
    """So that the pages of a payload that very many share can be split: no aggregate stands between them and their join."""
    source = pages(spark, [(k, "u", LONG if k % 3 else LONG + str(k)) for k in range(300)]).select("page_id", "html")
    found = warc.repeats(source)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "first-pages" not in plan.split("Join")[0] and "Aggregate" not in plan[plan.index("Join") :]
    assert found.count() == 199


def test_selected_records_and_small_archives(spark):
    rows = [(k, f"http://h/{k}", LONG + str(k)) for k in range(60)]
    folder = tempfile.mkdtemp(prefix="spark-")
    index = warc.write_archives(pages(spark, rows), folder, roll=2000)
    assert index.select("file").distinct().count() > 5
    got = {r["url"]: r["payload"].decode() for r in warc.read_records(index.where("page_id % 7 = 0"), folder).collect()}
    assert got == {u: h for i, u, h in rows if i % 7 == 0}


def test_url_rules_match_brute_force(spark):
    r = random.Random(8)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "a.com.", "net", "", "c.net", "a..com"]
    rules = [(r.choice(hosts[:4] + ["net"]), r.choice(["/", "/x", "/x/", ""]), r.choice(["allow", "block"])) for _ in range(9)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    rows = [(k, f"http://{r.choice(hosts).upper() if k % 3 else r.choice(hosts)}{r.choice(['', '/', '/x', '/x/y', '/xz'])}{r.choice(['', '?a=/x', '#/x/', '?u=http://net/'])}", "") for k in range(300)]
    rows += [(900, None, ""), (901, "nothing", ""), (None, "http://a.com/x", ""), (1, "http://a.com/x", "")]
    lower = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)

    def judged(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        h, p = (lower(m[1]), m[2]) if m else ("", "")
        fit = [(len(a + b), len(a), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return h, p, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"

    got = sorted((tuple(x) for x in urlfilter.judge(pages(spark, rows), urlfilter.rule_table(spark, rules)).collect()), key=str)
    assert got == sorted(((i, *judged(u)) for i, u, _ in rows), key=str)
    assert urlfilter.judge(pages(spark, []), urlfilter.rule_table(spark, rules)).count() == 0
    assert urlfilter.judge(pages(spark, rows), urlfilter.rule_table(spark, [])).where("verdict = 'allow' and rule is null").count() == len(rows)


def test_decoding_keeps_parents():
    parent, odds = [-1, 0, 1, 1, 0, 4], np.array([-1.0, -1, 3, -2, -1, 0.5])
    assert htmltext.decode(parent, odds).tolist() == [True, True, True, False, False, False]


def test_generated_pages_that_training_did_not_see():
    model = htmltext.train(pages=200, seed=1)
    maker = htmltext._Maker(99)
    right = total = 0
    for _ in range(60):
        page, y = htmltext.labelled(maker.page())
        keep = htmltext.decode(page.parent, model.raw(htmltext.features(page)))
        leaf = np.array([t is not None for t in page.text])
        right += int((keep[leaf] == y[leaf].astype(bool)).sum())
        total += int(leaf.sum())
    assert right / total > 0.95


def quality(model, maker, n=150, renamed=False):
    """Precision and recall, by characters, on generated pages, whose names may be turned into others."""
    right = said = there = 0
    for _ in range(n):
        source = maker.page()
        if renamed:
            source = re.sub('(class|id)="([^"]*)"', lambda m: f'{m[1]}="z{hashlib.md5(m[2].encode()).hexdigest()[:9]}"', source)
        page, y = htmltext.labelled(source)
        keep = htmltext.decode(page.parent, model.raw(htmltext.features(page)))
        for i, text in enumerate(page.text):
            if text is not None:
                right, said, there = right + len(text) * int(keep[i] and y[i]), said + len(text) * int(keep[i]), there + len(text) * int(y[i])
    return right / said, right / there


def test_names_never_seen():
    model = htmltext.train()
    for maker, renamed in ((htmltext._Maker(71, 0.0), False), (htmltext._Maker(72, 0.0), True), (htmltext._Maker(73, 1.0), False)):
        assert min(quality(model, maker, renamed=renamed)) > 0.95
    text, more = "Some words here, and more of them. " * 20, "More text follows. " * 15
    talk = "".join(f"<div class='x7'><a href=u>reader {k}</a><p>I think so, too, and thank you.</p></div>" for k in range(3))
    for page in (
        f"<body><article><h1>T</h1><p>{text}</p><p>{more}</p></article><section id='reacties'><h3>Reacties</h3>{talk}</section></body>",
        f"<body><div class='verhaal'><h1>T</h1><p>{text}</p><div class='gesponsord'><p>Koop nu deze fiets.</p></div><p>{more}</p></div><div class='talk'>{talk}</div></body>",
        f"<body><div class='b1'><a href=a>Home</a> <a href=b>News</a></div><article><header><h1>T</h1></header><p>{text}</p><p>{more}</p></article></body>",
    ):
        assert htmltext.texts_of([page], model) == [f"T {text.strip()} {more.strip()}"]


def test_extraction_of_whole_pages(spark):
    body = "".join(f"<p>Paragraph {k} &amp; more,\n  with <b>bold</b> words and enough of them to be text.<br>Second line." for k in range(6))
    page = f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A title of the page</h1>{body}</article><div class='comments'><p>First!</p></div><footer>&copy; us</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "<div>" * 2000), (1, "u", page)]
    got = [tuple(r) for r in htmltext.extract(pages(spark, rows)).collect()]
    text = "A title of the page " + " ".join(f"Paragraph {k} & more, with bold words and enough of them to be text. Second line." for k in range(6))
    assert got.count((1, "u", text, len(text))) == 2
    assert (2, None, "", 0) in got and (3, "u", "", 0) in got and len(got) == len(rows)
    assert htmltext.extract(pages(spark, [])).count() == 0


def test_text_behind_elements_that_are_left_out():
    texts = lambda source: [t for t in htmltext.parse(source).text if t is not None]
    for dropped in (
        '<svg class="i"/>', "<svg/>", '<svg title="a>b" />', '<svg><style/></svg>', "<svg><svg>x</svg>y</svg>", '<svg-icon name="x"></svg-icon>', "<object-view></object-view>", "<style-guide>", "<textarea-x>",
        "<svg>", "<object data=x>", "<select>", "<template>", "<noscript>", "<svg><path></svg>", "<object>x</object>", "<SELECT><option>x</SELECT>", "<template><p>x</template>", "<noscript><style></noscript>",
        "<script>x</script>", "<style>x</style >", "<iframe>x</iframe>", "<textarea>x</textarea x>",
    ):
        assert texts(f"<p>a {dropped} b</p><p>rest of article</p>") == ["a b", "rest of article"], dropped
        assert texts(f"<p>a {dropped} b</p><p>rest</p><svg>x</svg><object>x</object><select>x</select><noscript>x</noscript><template>x</template>") == ["a b", "rest"], dropped


def test_extraction_from_the_test_pages(spark):
    found = queries.op10_html_extraction(spark, "/root/testdata/sf0.001").toPandas()
    source = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").toPandas().set_index("page_id")["html"]
    for page_id, text in zip(found["page_id"], found["text"], strict=True):
        inside = re.search(r"<article>(.*?)</article>", source[page_id], re.S)[1]
        import html as h

        blocks = (" ".join(h.unescape(re.sub(r"<[^>]+>", " ", b.replace("<b>", "").replace("</b>", ""))).split()) for b in re.split(r"</?(?:p|h1|div|nav)\b[^>]*>", inside))
        assert text == " ".join(b for b in blocks if b)


def calls_table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, call_id string, turn long, idx int, name string, arguments string, depends_on array<string>")


def test_tool_calls(spark):
    say = lambda turn, role, text: (1, turn, role, text if isinstance(text, str) or text is None else json.dumps(text))
    call = lambda i, name, arguments, after=(): {"id": i, "name": name, "arguments": arguments, "depends_on": list(after)}
    rows = [
        say(0, "user", "hello {"), say(1, "assistant", {"tool_calls": [call("a", "add", {"y": 2, "x": 1}), call("b", "add", {"x": "1"}, ["a"]), call("c", "gone", {}), call("d", "add", '{"x": 1, "z": {"b": 1, "a": [2, 1.50]}}', ["nothing"])]}),
        say(2, "tool", {"tool_call_id": "a", "content": "3"}), say(3, "tool", {"tool_call_id": "q", "content": {"k": 1}}), say(0, "tool", {"tool_call_id": "b", "content": "early"}), say(4, "assistant", "{broken"), say(5, "assistant", None), say(None, None, ""),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schemas = chat.schema_table(spark, {"add": {"x": ("integer", True), "y": ("number", False)}})
    got = {r["call_id"]: r for r in chat.link(*chat.tool_messages(messages), schemas).collect()}
    assert {k: (r["status"], r["problem"]) for k, r in got.items()} == {"a": ("linked", None), "b": ("early", "wrong type: x"), "c": ("unanswered", "unknown tool"), "d": ("unresolved", "unknown: z"), "q": ("orphan", None)}
    assert json.loads(got["a"]["json"]) == {"arguments": {"x": 1, "y": 2}, "conversation": 1, "id": "a", "name": "add", "result": "3", "status": "linked"}
    assert got["d"]["json"].startswith('{"arguments":{"x":1,"z":{"a":[2,1.5],"b":1}}')
    empty = messages.where("false")
    assert chat.link(*chat.tool_messages(empty), schemas).count() == 0


def test_topological_order_and_cycles(spark):
    rows = [(1, "a", 0, 0, "t", "{}", ["b"]), (1, "b", 0, 1, "t", "{}", ["c"]), (1, "c", 5, 0, "t", "{}", []), (2, "x", 0, 0, "t", "{}", ["y"]), (2, "y", 1, 0, "t", "{}", ["x"]), (2, "z", 2, 0, "t", "{}", []), (None, None, None, 0, None, None, None)]
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(calls_table(spark, rows), results, chat.schema_table(spark, {"t": {}})).collect()}
    assert [got[1, k]["stage"] for k in "cba"] == [0, 1, 2]
    assert got[2, "x"]["status"] == got[2, "y"]["status"] == "cycle" and got[2, "z"]["stage"] == 0
    assert got[-1, ""]["problem"] == "unknown tool"


def test_levels_of_chains_trees_and_cycles(spark):
    """The longest chain below each call, with a long chain, a random graph and a cycle with calls behind it."""
    r = random.Random(12)
    needs = {(1, str(k)): [str(k + 1)] if k < 70 else [] for k in range(71)}
    needs |= {(2, str(k)): sorted({str(r.randrange(k + 1, 26)) for _ in range(r.randrange(3))}) if k < 25 else [] for k in range(26)}
    needs |= {(3, "a"): ["b"], (3, "b"): ["c"], (3, "c"): ["a"], (3, "d"): ["a", "e"], (3, "e"): []}

    def level(call, seen=()):
        if call in seen:
            return None
        below = [level((call[0], n), (*seen, call)) for n in needs[call]]
        return None if None in below else 1 + max(below, default=-1)

    calls = spark.createDataFrame(list(needs), "conv_id long, call_id string")
    edges = spark.createDataFrame([(*c, n) for c, ns in needs.items() for n in ns], "conv_id long, call_id string, needs string")
    got = {(x["conv_id"], x["call_id"]): x["level"] for x in chat.levels(calls, edges).collect()}
    assert got == {c: level(c) for c in needs if level(c) is not None} and len(got) == len(needs) - 4


def linked(calls, results, tools):
    """(conv_id, call_id): turn, stage, idx, status, n_results and the JSON's result, by plain loops."""
    first, answers = {}, {}
    for c in calls:
        key = (c["conv_id"], c["call_id"])
        first[key] = min(first.get(key, c), c, key=lambda x: (x["turn"], x["idx"], x["arguments"]))
    for r in results:
        answers.setdefault((r["conv_id"], r["call_id"]), []).append(r)
    stages = {}

    def stage(key, path=()):
        if key in path:
            return None
        if key not in stages:
            below = [stage((key[0], n), (*path, key)) for n in set(first[key]["depends_on"]) if (key[0], n) in first]
            if None in below:
                return None
            stages[key] = 1 + max(below, default=-1)
        return stages[key]

    out = {}
    for key in {*first, *answers}:
        c, r = first.get(key), min(answers.get(key, []), key=lambda x: (x["turn"], x["content"]), default=None)
        if c is None:
            out[key] = (r["turn"], None, None, "orphan", len(answers[key]), r["content"])
            continue
        lacks = any((key[0], n) not in first for n in c["depends_on"])
        level = stage(key)
        status = "unresolved" if lacks else "cycle" if level is None else "unanswered" if r is None else "early" if r["turn"] < c["turn"] else "linked"
        out[key] = (c["turn"], level, c["idx"], status, len(answers.get(key, [])), r and r["content"])
    return out


def test_every_turn_is_linked(spark):
    """Every row of the query, whole: stage, status, number of results and JSON."""
    talk = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    key = lambda r, turn: f"{r['conv_id']}-{turn}"
    calls = [
        {"conv_id": r["conv_id"], "call_id": key(r, r["turn"]), "turn": r["turn"], "idx": 0, "arguments": json.dumps({"prompt": r["text"], "turn": r["turn"]}, separators=(",", ":"), ensure_ascii=False), "depends_on": [key(r, r["turn"] - 2)] if r["turn"] >= 2 else []}
        for r in talk if r["role"] == "user"
    ]
    results = [{"conv_id": r["conv_id"], "call_id": key(r, r["turn"] - 1), "turn": r["turn"], "content": r["text"]} for r in talk if r["role"] == "assistant"]
    want, arguments = linked(calls, results, None), {(c["conv_id"], c["call_id"]): json.loads(c["arguments"]) for c in calls}
    got = queries.op1_chat_formatting(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(want) and len({w[1] for w in want.values()}) > 2
    for r in got:
        k = r["conv_id"], r["call_id"]
        doc = json.loads(r["json"])
        assert (r["turn"], r["stage"], r["idx"], r["status"], r["n_results"], doc.get("result")) == want[k]
        assert (r["name"], r["problem"]) == (("reply", None) if k in arguments else (None, None))
        assert doc == {x: y for x, y in {"arguments": arguments.get(k), "conversation": k[0], "id": k[1], "name": r["name"], "result": want[k][5], "status": want[k][3]}.items() if y is not None or x in doc}


def test_random_calls_and_results(spark):
    """Forward, missing and cyclic dependencies, repeated calls and results, early ones and orphans, in many conversations."""
    r = random.Random(21)
    calls, results = [], []
    for conv in range(25):
        ids = [f"c{k}" for k in range(r.randrange(1, 9))]
        for k, i in enumerate(ids + r.choices(ids, k=2)):
            calls.append({"conv_id": conv, "call_id": i, "turn": r.randrange(9), "idx": k, "name": "t", "arguments": "{}", "depends_on": r.sample([*ids, "gone"] if r.random() < 0.3 else ids, r.choice([0, 0, 1, 2]) if len(ids) > 2 else 0)})
        results += [{"conv_id": conv, "call_id": r.choice([*ids, "lost"]), "turn": r.randrange(9), "content": f"r{n}"} for n in range(r.randrange(8))]
    schema = "conv_id long, call_id string, turn long, idx int, name string, arguments string, depends_on array<string>, status string, level int"
    table = spark.createDataFrame([(c["conv_id"], c["call_id"], c["turn"], c["idx"], "t", "{}", c["depends_on"], "clash", 9) for c in calls], schema)
    answers = spark.createDataFrame([(a["conv_id"], a["call_id"], a["turn"], a["content"], "clash") for a in results], "conv_id long, call_id string, turn long, content string, stage string")
    want = linked(calls, results, None)
    assert {w[3] for w in want.values()} == {"linked", "unanswered", "orphan", "early", "unresolved", "cycle"}
    got = chat.link(table, answers, chat.schema_table(spark, {"t": {}})).collect()
    assert {(x["conv_id"], x["call_id"]): (x["turn"], x["stage"], x["idx"], x["status"], x["n_results"], json.loads(x["json"]).get("result")) for x in got} == want


def test_a_very_long_text_is_a_call(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", None), (None, 0, "user", "x")]
    messages = spark.createDataFrame([(*row, "clash") for row in rows], "conv_id long, turn long, role string, text string, stage string")
    (a, x), (b, y) = chat.turns_as_calls(messages), chat.tool_messages(messages)
    got = {(r["conv_id"], r["turn"]): r for r in chat.link(a.unionByName(b), x.unionByName(y), chat.schema_table(spark, queries.CHAT_TOOLS)).collect()}
    assert json.loads(got[1, 0]["json"])["result"] == long and [(got[k]["stage"], got[k]["status"]) for k in ((1, 0), (1, 2), (-1, 0))] == [(0, "linked"), (1, "unanswered"), (0, "unanswered")]
