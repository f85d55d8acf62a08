"""Expansion of copybooks against a plain expander."""

import random
import re

from stratalith.operators import copybooks as C

COPY = re.compile(r"COPY (\w+)(?: REPLACING (.*?))?\.(?=\s|$)", re.S)


def swap(text, pairs):
    if not pairs:
        return text
    def pattern(kind, old):
        body = r"\s+".join(map(re.escape, old.split(" ")))
        word = lambda x: re.match(r"[A-Za-z0-9-]", x)
        before = "(?<=[A-Za-z0-9-])" if kind == "TRAILING" else "(?<![A-Za-z0-9-])" if kind == "LEADING" or word(old[0]) else ""
        behind = "(?=[A-Za-z0-9-])" if kind == "LEADING" else "(?![A-Za-z0-9-])" if kind == "TRAILING" or word(old[-1]) else ""
        return before + body + behind
    return re.sub("|".join(f"(?:{pattern(k, o)})" for k, o, _ in pairs), lambda m: next(n for _, o, n in pairs if o.upper() == re.sub(r"\s+", " ", m[0]).upper()), text, flags=re.I)


def expand(text, books, lists, chain, missing, cycles):
    out, at = [], 0
    for m in COPY.finditer(text):
        piece = text[at : m.start()]
        for pairs in lists:
            piece = swap(piece, pairs)
        out.append(piece)
        name, own = m[1].upper(), [(k or "", o or o2, n or n2) for k, o, o2, n, n2 in re.findall(r"(LEADING |TRAILING )?(?:==(.*?)==|([^\s=]+)) BY (?:==(.*?)==|([^\s=]+))", m[2] or "")]
        own = [(k.strip(), o, n) for k, o, n in own]
        if name in chain or name not in books:
            (cycles if name in chain else missing).add(name)
            out.append(m[0])
        else:
            out.append(expand(books[name], books, [own, *lists], [*chain, name], missing, cycles))
        at = m.end()
    piece = text[at:]
    for pairs in lists:
        piece = swap(piece, pairs)
    return "".join(out) + piece


def test_expansion_equals_a_plain_one(spark):
    rnd = random.Random(4)
    ops = ["==:T:== BY ==NAME==", "==A B== BY ==C==", "FLD BY OTHER", "LEADING ==PRE== BY ==POST==", "TRAILING ==-X== BY ==-Y==", "==OTHER== BY ==:T:==", "==NAME== BY ==FLD=="]
    def body():
        out = []
        for _ in range(rnd.randint(1, 6)):
            kind = rnd.random()
            if kind < 0.45:
                clause = " ".join(rnd.sample(ops, rnd.randint(1, 3)))
                out.append(f"  COPY B{rnd.randint(0, 9)}" + (f" REPLACING {clause}" if rnd.random() < 0.7 else "") + ".")
            else:
                out.append(f"  05 :T:-A {rnd.choice(['FLD', 'MY-FLD', 'A  B', 'PRE-X', 'OTHER', 'XFLD', 'NAME', 'fld'])} PIC X.")
        return "\n".join(out)
    books = {f"B{k}": body() for k in range(8)}
    sources = {k: body() for k in range(60)} | {98: "", 99: None}
    pieces = C.segments(spark.createDataFrame(list(sources.items()), "program long, source string"), "program", "source", spark.createDataFrame([(n.lower(), t) for n, t in books.items()], "name string, text string"))
    got = {r["program"]: (r["text"], r["missing"], r["cycles"]) for r in C.expanded(pieces, "program").collect()}
    for k, text in sources.items():
        missing, cycles = set(), set()
        want = expand(text or "", books, [], [], missing, cycles)
        assert got.get(k, ("", [], [])) == (want, sorted(missing), sorted(cycles))
    lines = {(r["program"], r["line"]): (r["book"], r["book_line"]) for r in C.line_map(pieces, "program").collect()}
    for k in sources:
        for i, x in enumerate(got.get(k, ("",))[0].split("\n")):
            book, at = lines.get((k, i + 1), (None, None))
            assert (at is None) == (not x.strip())
            if at and "COPY" not in (origin := (books[book] if book else sources[k]).split("\n")[at - 1]):
                assert origin.split()[-1] == x.split()[-1] or "COPY" in x
    assert any(b for b, _ in lines.values())


def test_groups_of_parameters(spark):
    text = "==A-1==" + " " * 192 + "==12==" + " " * 194 + "==PIC X(9)== ==usage COMP==" + " " * 300 + "=='x'=="
    rows = C.replacing_groups(spark.createDataFrame([(1, text), (2, None), (3, "==a b==")], "k long, t string"), "k", "t").orderBy("group").collect()
    assert [(r["n"], r["kinds"], r["values"], r["first"], r["last"]) for r in rows] == [(2, ["numeric", "variable"], ["A-1", "12"], 0, 199), (2, ["pic", "usage"], ["X(9)", "COMP"], 399, 412), (1, ["literal"], ["'x'"], 726, 726)]
