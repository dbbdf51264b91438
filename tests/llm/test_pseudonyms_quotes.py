import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from gradeloom.llm import pseudonyms, quotes


def feistel(values, bases, key, kind):
    state = list(values)
    for i in range(1, pseudonyms.ROUNDS + 1):
        other = ",".join(str(x) for j, x in enumerate(state) if (j + i) % 2 == 1)
        move = lambda j: int(hashlib.sha256(f"{key}|{kind}|{i}|{j}|{len(state)}|{other}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        state = [(x + move(j)) % bases[j] if (j + i) % 2 == 0 else x for j, x in enumerate(state)]
    return state


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0


def card(rng):
    d = [4] + [rng.randint(0, 9) for _ in range(14)]
    return "".join(map(str, next(d + [c] for c in range(10) if luhn(d + [c]))))


def test_network_against_python(spark):
    rng = random.Random(3)
    values = [[rng.randint(0, 255) for _ in range(4)] for _ in range(20)]
    df = spark.createDataFrame([(v,) for v in values], "v array<long>")
    got = df.select(pseudonyms.feistel(F.col("v"), F.array_repeat(F.lit(256).cast("long"), 4), "k", "address").alias("x")).collect()
    assert [r.x for r in got] == [feistel(v, [256] * 4, "k", "address") for v in values]


def test_values_keep_their_format(spark):
    rng = random.Random(4)
    start = datetime.date(1900, 1, 1)
    day = lambda: start + datetime.timedelta(rng.randint(0, 73048))
    made = {
        "card": [card(rng) for _ in range(30)], "address": [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(30)],
        "phone": [f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}" for _ in range(30)], "date": [day().isoformat() for _ in range(30)],
        "us": [day().strftime("%m/%d/%Y") for _ in range(30)], "security": [f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(30)],
        "mail": [f"{''.join(rng.choice('abcDEF.') for _ in range(5))}x{rng.randint(10, 99)}@mail.example.com" for _ in range(30)],
        "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    }
    rows = [(k, v) for k, vs in made.items() for v in dict.fromkeys(vs)]
    df = spark.createDataFrame(rows, "kind string, value string").withColumn("new", pseudonyms.pseudonym(F.col("value")))
    out = df.collect()
    for kind in made:
        assert len({r.new for r in out if r.kind == kind}) == len({r.value for r in out if r.kind == kind})
    for r in out:
        assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", r.new))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", r.value))) or r.kind == "address"
        if r.kind == "card":
            assert luhn([int(c) for c in r.new]) and r.new[0] == r.value[0]
        if r.kind == "address":
            assert all(0 <= int(p) <= 255 for p in r.new.split("."))
        if r.kind == "date":
            assert 1900 <= datetime.date.fromisoformat(r.new).year <= 2099
        if r.kind == "security":
            assert r.new[:3] not in ("000", "666") and r.new[:3] < "900" and r.new[4:6] != "00" and r.new[7:] != "0000"
        if r.kind == "iban":
            plain = r.new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_documents(spark):
    rows = [(1, "a 4337166598464399 b 4337166598464399, 4337166598464398"), (2, "x 4337166598464399"), (3, None), (4, ""), (5, "Version 2.0 in 12 parts, 2/30/2001, 999.1.1.1"), (6, "word " * 20000 + "1.2.3.4"), (2, "x 4337166598464399"), (None, "bo.42@m.example.com")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_replaced int")
    out = pseudonyms.pseudonymise(df).collect()
    new = {r.doc_id: r.text for r in out}
    first = new[2].split()[1]
    assert new[1] == f"a {first} b {first}, 4337166598464398" and first != "4337166598464399" and luhn([int(c) for c in first])
    assert new[3] is None and new[4] == "" and new[5] == rows[4][1] and new[6].startswith("word word") and not new[6].endswith(" 1.2.3.4")
    assert len(out) == len(rows) and sum(r.n_replaced for r in out) == 6
    assert pseudonyms.pseudonymise(df.limit(0)).count() == 0
    assert not any(x in pseudonyms.pseudonymise(df)._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "Hello there friend\nHow are you?"), (1, 1, "assistant", "On Monday X wrote:\n> Hello there   friend\n> How are you?\nFine thanks"), (1, 2, "user", ">> Hello there friend\n> Fine thanks\n\nGood"),
        (1, 3, "user", "> how are you?\nAlso me"), (2, 0, "user", None), (2, 1, "user", "> nothing known\nx"), (None, 0, "user", "> a\nb"), (3, 5, "user", "> self\nself"), (4, 0, "user", "same"), (4, 1, "user", "same"), (4, 1, "user", "same"),
        (4, 2, "user", "> same\nyes"), (5, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, line string")
    out = quotes.link_quotations(df).collect()
    got = {(r.conv_id, r.turn): (r.text, r.parent_turn, r.root_turn, r.depth) for r in out}
    assert len(out) == len(rows)
    assert got[1, 1] == ("Fine thanks", 0, 0, 1) and got[1, 2] == ("Good", 1, 0, 2) and got[1, 3] == ("Also me", 0, 0, 1)
    assert got[2, 0] == (None, None, 0, 0) and got[2, 1] == ("x", None, 1, 0) and got[3, 5] == ("self", None, 5, 0) and got[4, 2] == ("yes", 1, 1, 1)
    assert quotes.link_quotations(df.limit(0)).count() == 0


def test_long_thread(spark):
    rows = [(1, 0, "user", "line 0")] + [(1, i, "user", f"> line {i - 1}\nline {i}") for i in range(1, 20)]
    out = {r.turn: r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[i].parent_turn == i - 1 and out[i].root_turn == 0 and out[i].depth == i for i in range(1, 20))


def test_neighbours_of_cards_and_ibans(spark):
    """Values are found whatever digits or letters stand next to them, and their neighbours too."""
    rng = random.Random(8)
    c = [card(rng) for _ in range(4)]
    four = lambda x: " ".join(x[i : i + 4] for i in range(0, 16, 4))
    texts = {
        1: f"{c[0]} 233.254.104.120", 2: f"{four(c[0])} 12/26", 3: f"card {four(c[0])} 3.", 4: f"12 {four(c[0])}", 5: f"{c[0]} {c[1]}", 6: f"{four(c[0])} {four(c[1])} {four(c[2])}",
        7: "BE68 5390 0754 7034 I am", 8: "pay BE68 5390 0754 7034 ABCD now", 9: "BE68 5390 0754 7035 I am", 10: f"123456 {four(c[3])}", 11: " ".join("7" * 30) + f" {four(c[2])}", 12: "1 " * 40_000,
        13: f"\ufdd0 {c[0]}", 14: f"{four(c[1])}\n2021-03-04",
    }
    df = spark.createDataFrame([(i, t, "v", "n") for i, t in texts.items()], "doc_id long, text string, marked_text string, found_values string")
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    assert all(r.marked_text == "v" and r.found_values == "n" for r in out.values())
    alone = spark.createDataFrame([(x,) for x in [*c, *map(four, c), "233.254.104.120", "BE68 5390 0754 7034", "2021-03-04"]], "v string").select("v", pseudonyms.pseudonym(F.col("v"), "k").alias("new"))
    new = {r.v: r.new for r in alone.collect()}
    expected = {i: t for i, t in texts.items()}
    for i, t in texts.items():
        for v in sorted(new, key=len, reverse=True):
            expected[i] = expected[i].replace(v, new[v]) if i != 9 else t
    assert {i: r.text for i, r in out.items()} == expected
    assert [out[i].n_replaced for i in range(1, 15)] == [2, 1, 1, 1, 2, 3, 1, 1, 0, 1, 1, 0, 1, 2]


MAIL = "We met the builder on Monday and she said that the roof needs new beams before winter comes.\nThe price is fixed."


def test_wrapped_partial_and_nested_quotes(spark):
    """Passages link however they are wrapped, in part, and at every level; quotes without an original stay."""
    words = MAIL.split(" ")
    wrapped = "\n".join("> " + " ".join(words[i : i + 5]) for i in range(0, 15, 5))
    rows = [
        (1, 0, "a", MAIL), (1, 1, "b", wrapped + "\n\nThat is dear, let us ask the other firm too."), (1, 2, "c", "B wrote:\n> > the roof needs new beams\n> That is dear, let us ask the other firm too.\n\nAgreed then."),
        (1, 3, "d", "> a passage that nobody here ever said before\nOdd."), (1, 4, "a", "> how are\n> things\nYes"), (1, 5, "e", ">> a lost answer between the two of them\n>>> builder on Monday and she said that\nHm"), (2, 0, "a", "how are things"), (2, 1, "b", "> how are\n> things\nfine"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn): r for r in quotes.in_reply_order(quotes.link_quotations(df)).collect()}
    assert {k: (r.parent_turn, r.depth, r.position) for k, r in out.items()} == {
        (1, 0): (None, 0, 0), (1, 1): (0, 1, 1), (1, 2): (1, 2, 2), (1, 3): (None, 0, 0), (1, 4): (None, 0, 0), (1, 5): (0, 1, 3), (2, 0): (None, 0, 0), (2, 1): (0, 1, 1),
    }
    assert [(x.level, x.to) for x in out[1, 2].links] == [(1, 1), (2, 0)] and out[1, 2].text == "Agreed then."
    assert out[1, 3].unlinked == ["> a passage that nobody here ever said before"] and out[1, 3].text == "Odd." and out[1, 1].unlinked == []
    assert out[1, 5].unlinked == [">> a lost answer between the two of them"]
    built = {(r.conv_id, r.root_turn, r.part): r for r in quotes.build_conversations(quotes.in_reply_order(quotes.link_quotations(df)), 3).collect()}
    assert built[1, 0, 0].text == f"<|a|>\n{MAIL}\n<|b|>\nThat is dear, let us ask the other firm too.\n<|c|>\nAgreed then.\n" and built[1, 0, 1].n_messages == 1


def test_links_against_brute_force(spark, monkeypatch):
    """Random threads with quotes: parents as plain Python finds them, whatever the size of the blocks of turns."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for conv in range(6):
        said = []
        for turn in range(25):
            mine = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14)))
            quote = ""
            if said and rng.random() < 0.7:
                w = rng.choice(said).split()
                at = rng.randint(0, max(0, len(w) - 6))
                quote = "> " + " ".join(w[at : at + rng.randint(5, 8)]) + "\n"
            rows.append((conv, turn, "x", quote + mine))
            said.append(mine)

    def units(text):
        w = text.split()
        return {text} | ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {" ".join(w)})

    want = {}
    for conv, turn, _, text in rows:
        head, _, _ = text.rpartition("\n")
        votes = {}
        for u in units(head[2:]) if head else ():
            back = [t for c, t, _, x in rows if c == conv and t < turn and u in units(x.rpartition("\n")[2])]
            if back:
                votes[max(back)] = votes.get(max(back), 0) + 1
        want[conv, turn] = max(votes, key=lambda t: (votes[t], t)) if votes else None
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for turns in (quotes.TURNS, 3):
        monkeypatch.setattr(quotes, "TURNS", turns)
        out = quotes.in_reply_order(quotes.link_quotations(df)).collect()
        assert {(r.conv_id, r.turn): r.parent_turn for r in out} == want
        threads = {}
        for r in sorted(out, key=lambda r: r.position):
            threads.setdefault((r.conv_id, r.root_turn), []).append((r.position, r.turn))
        assert all([p for p, _ in t] == list(range(len(t))) and [x for _, x in t] == sorted(x for _, x in t) for t in threads.values())
