"""Quotation linking against a plain version of its rules."""

import random
import re

from sparklog.llm import chat, queries


def key(s):
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def plain(messages):
    """Per (conv, turn): body, answered turn, quotes, linked, place in reply order."""
    out = {}
    convs = {}
    for c, t, role, text in messages:
        if c is not None and t is not None:
            m = (role if role is not None else "user", text or "")
            convs.setdefault(c, {})
            convs[c][t] = min(convs[c].get(t, m), m)
    for c, turns in convs.items():
        parsed, offers = {}, {}
        for t in sorted(turns):
            body, quotes, open_depth = [], [], 0
            for line in re.sub(r"\r\n?", "\n", turns[t][1]).split("\n"):
                m = re.match(r"[ \t]*((?:>[ \t]*)*)", line)
                depth = m[1].count(">")
                rest = line[m.end() :]
                if not depth:
                    body.append(line)
                elif depth == open_depth:
                    quotes[-1][1] += "\n" + rest
                else:
                    quotes.append([depth, rest])
                open_depth = depth
            parsed[t] = ("\n".join(body).strip(" "), quotes)
            for piece in [parsed[t][0], *parsed[t][0].split("\n")]:
                if key(piece):
                    offers.setdefault(key(piece), t)
        answers, linked = {}, {}
        for t, (_, quotes) in parsed.items():
            hits = [(d, i, offers[key(q)]) for i, (d, q) in enumerate(quotes) if key(q) and offers.get(key(q), t) < t]
            linked[t] = len(hits)
            if hits:
                answers[t] = min(hits)[2]
        order, children, follow, last = [], {}, {}, None
        for t in sorted(parsed):
            if t in answers:
                children.setdefault(answers[t], []).append(t)
            elif last is not None:
                follow[last] = t
            last = t
        first = min(parsed)

        def walk(t):
            while t is not None:
                order.append(t)
                for k in children.get(t, []):
                    walk(k)
                t = follow.get(t)

        walk(first)
        for t in parsed:
            out[(c, t)] = (parsed[t][0], answers.get(t), len(parsed[t][1]), linked[t], order.index(t))
    return out


def got(df):
    rows = chat.conversations(df).collect()
    found = {(r.conv_id, r.turn): (r.body, r.answers, r.n_quotes, r.n_linked, r.position) for r in rows}
    assert len(found) == len(rows)
    return found


def thread(r, c, n):
    says = ["Hello there", "ok", "The plan is late", "yes, agreed", "No way", "see line one\nand line two"]
    rows, bodies = [], []
    for t in range(n):
        text = r.choice(says) + f" {t}" * r.randrange(2)
        bodies.append(text)
        if t and r.random() < 0.5:
            for _ in range(r.randint(1, 2)):
                quoted = r.choice(bodies[:-1] + ["never said"])
                marks = r.choice(["> ", ">", ">> ", "> > "])
                text = "\n".join(marks + x.upper() for x in quoted.split("\n")) + "\n" + text
        rows.append((c, t * r.choice([1, 1]) + t * 0, r.choice(["user", "assistant", None]), text))
    return rows


def test_links_and_order(spark):
    r = random.Random(8)
    rows = [x for c in range(30) for x in thread(r, c, r.randint(1, 25))]
    rows += [(50, 0, "user", None), (50, 1, "user", "> "), (50, 1, "assistant", "> x"), (None, 1, "user", "a"), (51, None, "user", "a"), (52, 3, "user", "late start"), (52, 9, "user", ">late START!\r\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as body", "'x' as branch")
    assert got(df) == plain(rows)


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 5)
    rows = thread(random.Random(2), 1, 80)
    assert got(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")) == plain(rows)


def test_deep_thread_and_wide_star(spark, monkeypatch):
    """Each message quotes the one before (a chain), and all quote the first (a star): positions are turns, and no row grows."""
    monkeypatch.setattr(chat, "SPAN", 64)
    rows = [(1, t, "user", (f"> note {t - 1}\n" if t else "") + f"note {t}") for t in range(600)]
    rows += [(2, t, "user", ("> opening words\n" if t else "") + f"{'opening words' if not t else f'reply {t}'}") for t in range(600)]
    found = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(found) == 1200 and all(r.position == r.turn for r in found)
    assert all(r.answers == (None if not r.turn else r.turn - 1 if r.conv_id == 1 else 0) for r in found)


def test_attributions_and_long_messages(spark):
    long = "\n".join(f"> line {i}" if i % 3 else f">> deep {i}" for i in range(20_000))
    rows = [(1, 0, "user", "Shall we go?"), (1, 1, "user", "On 1 May 2026, A. Person wrote:\n> Shall we go?\nYes"), (1, 2, "user", "Am 1. Mai schrieb B.:\n\n> On Monday C wrote:\n>> Shall we go?\n> Yes\nfine, he wrote:\nand so on"), (2, 0, "user", long + "\nend")]
    found = {(r.conv_id, r.turn): r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found[1, 1].body == "Yes" and found[1, 1].answers == 0
    assert found[1, 2].body.strip() == "fine, he wrote:\nand so on" and found[1, 2].answers == 1 and found[1, 2].n_linked == 2
    assert found[2, 0].body == "end" and found[2, 0].n_quotes == 13334


def test_query_and_empty(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert {(r.conv_id, r.turn): (r.body, r.answers, r.n_quotes, r.n_linked, r.position) for r in queries.op10_quotation_linking(spark, sf_dir).collect()} == plain(rows)
    assert got(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}
    assert chat.conversations(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")).first().chat == "<|user|>\nhi\n"


def test_partial_interleaved_and_rewrapped_quotes(spark):
    said = "First point here.\nSecond point\n\nA third, rather long point that some program wraps anew.\nlast"
    rows = [(1, 0, "user", said), (1, 1, "user", "other"), (1, 2, "user", "> Second point\n>\n> A third, rather long point that some program wraps anew.\nyes")]
    rows += [(1, 3, "user", "> A third, rather long\n> point that some\n> program wraps anew.\nno"), (1, 4, "user", "> First point here.\n> Second point\nok\n> third, rather\nok")]
    rows += [(1, 5, "user", "> here second\n> third\nwords left out"), (1, 6, "user", "> other\n> last\nwords of two"), (1, 7, "user", "> yes no\nfrom nobody")]
    rows += [(2, 0, "user", "hello"), (2, 1, "user", "l1\nl2\n> hello\nl3\nl4"), (2, 2, "user", "> l1\n> l2\n>> hello\n> l3\n> l4\nall of it"), (3, 0, "user", "> said later on\na"), (3, 1, "user", "it is said later on here")]
    linked = {(r.conv_id, r.turn): (r.answers, r.n_linked) for r in chat.link(chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert linked == {(1, 2): (0, 1), (1, 3): (0, 1), (1, 4): (0, 2), (2, 1): (0, 1), (2, 2): (1, 3)}
