"""Programs as statements in order: tidy text, flow of control, flow of values, sequences of calls.

A source is brought into free form (``tidy``), cut into statements whatever
its lines are (``statements``), and everything else is joins and windows over
these rows.  Literals are never looked into.

Edge cases: a null source has no statements.  Names are compared in upper case.
A target that a program does not have leads nowhere.  Loops are followed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept

NAME = "[A-Z0-9][A-Z0-9-]*"
KEY = "_key"  # what the sources' key is called within
#: The words that statements begin with.
VERBS = (
    "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE ELSE ENTRY EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY NEXT OPEN "
    "PERFORM READ RELEASE RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WHEN WRITE"
).split()
#: Words that a line may hold alone, with a period, and that are no paragraph.
ALONE = ("EXIT", "GOBACK", "CONTINUE", "ELSE", "STOP")
_EDGE, _BLANK, _DOT, _JOIN = "\u0001", "\u0007", "\u0008", "\u0004"
_STOP, _PART, _WING, _HEAD = "\u0002", "\u0003", "\u0005", "\u0006"
# a letter is looked for first: at the many blanks none of the words need be tried
_VERB = rf"(?<![A-Z0-9'\"-])(?=[A-Z])({'|'.join(VERBS)}|END-[A-Z]+|PROCEDURE(?= +DIVISION))(?![A-Z0-9'\"-])"
_LITERAL = r"('[^'\n]*'?|\"[^\"\n]*\"?|[^'\"]+)"


def tidy(text: Column) -> Column:
    """A source without sequence numbers, identification area and comments, its continued lines joined; every statement stays on its line.

    A line is in fixed form if six digits stand before column 7, or six blanks with eight digits from column 73 on.
    """
    # In this order, each in one pass over the whole text; nothing is done line by line in a lambda.  What is looked at more than once is
    # bound by bound, or Spark would work it out again for each use; continued lines are looked for by regular expression only where there are any.
    fixed = (
        (r"(?md)^[0-9]{6}(?=[ *\-/\n]|\z)(.{0,66}).*$", "      $1"),
        (r"(?md)^( {6}[ *\-/].{65})[0-9]{8}[^\S\n]*$", "$1"),
        (r"(?md)^(?:[^\S\n]*\*|.{6}[*/]|//\*).*$", ""),
    )
    continued = ((r"\n {6}- *['\"]", _JOIN), (r" *\n {6}- *+(?!['\"])", _JOIN))

    def passed(x: Column, steps: tuple[tuple[str, str], ...]) -> Column:
        for pattern, new in steps:
            x = F.regexp_replace(x, pattern, new)
        return x

    def whole(x: Column) -> Column:
        bare = F.replace(x, F.lit(_JOIN), F.lit(""))
        return F.concat(bare, F.repeat(F.lit("\n"), F.length(x) - F.length(bare)))  # lines below keep their numbers

    def joined(x: Column) -> Column:
        more = rf"[^\n]*{_JOIN}[^\n]*"
        parts = F.arrays_zip(F.split(x, more).alias("p"), F.regexp_extract_all(x, F.lit(more), F.lit(0)).alias("h"))
        return F.array_join(F.transform(parts, lambda z: F.concat(z["p"], F.coalesce(whole(z["h"]), F.lit("")))), "")

    free = passed(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), fixed)
    has = [lambda x, mark=mark: F.contains(x, F.lit(mark)) for mark in ("\n      -", _JOIN)]
    return bound(free, lambda x: F.when(has[0](x) | has[1](x), bound(passed(x, continued), lambda y: F.when(has[1](y), joined(y)).otherwise(y))).otherwise(x))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is worked out once."""
    return F.transform(F.array(value), use)[0]


def statements(sources: DataFrame, key: str, text: str, verbs: tuple[str, ...] = ()) -> DataFrame:
    """The statements of the procedure division: key, n (in order), line, section, paragraph, place (number of the paragraph), sentence, verb, body, conditional.

    Paragraphs and sections have rows of their own with the verbs LABEL and SECTION; the header's verb is PROCEDURE.  A
    paragraph's name stands alone with a period, below a period.  A statement is conditional if an IF, EVALUATE or SEARCH of its sentence is open before it; a period ends them all.
    An EXEC is one statement up to the next END-EXEC.  verbs: of the other statements only those with these verbs are taken apart, and n counts these; none: all.
    """
    return sources.select(F.col(key), F.posexplode(_cut(tidy(F.col(text)), verbs)).alias("n", "s")).select(key, F.col("n").cast("long").alias("n"), "s.*")


def _cut(text: Column, verbs: tuple[str, ...] = ()) -> Column:
    """The statements of a tidy text as an array, cut in its row: nothing is sorted or shuffled, however many lines there are.

    Marks are put before statements (_EDGE), periods (_STOP), paragraphs (_PART) and sections (_WING).  What is counted from the text's head is
    written behind the marks by cutting the text at what is counted: each piece has its number.  So every step is one pass, and none adds to an array.
    """
    marks = f"[{_EDGE}{_STOP}{_PART}{_WING}]"

    def within(x: Column, cut: str, use: Callable[[Column, Column], Column], glue: str) -> Column:
        return F.array_join(F.transform(F.split(x, cut), use), glue)

    def swapped(x: Column, pattern: str, use: Callable[[Column], Column]) -> Column:
        """The text with each match replaced by what use makes of it."""
        parts = F.arrays_zip(F.split(x, pattern).alias("p"), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("h"))
        return F.array_join(F.transform(parts, lambda z: F.concat(z["p"], use(F.coalesce(z["h"], F.lit(""))))), "")

    def masked(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(_LITERAL), F.lit(1))
        return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^['\"]"), F.translate(p, " .", _BLANK + _DOT)).otherwise(F.upper(p))), "")

    # a quote before a paragraph's or section's name keeps verbs from being found in it
    x = bound(text, lambda t: F.when(F.contains(t, F.lit("'")) | F.contains(t, F.lit('"')), masked(t)).otherwise(F.upper(t)))
    gap, no_name = r"[^\S\n]", rf"(?!(?:{'|'.join(ALONE)})(?![A-Z0-9-])|END-)"
    x = F.regexp_replace(x, rf"(?md)(\A(?: *\n)*|\. *\n(?: *\n)*) {{0,7}}{no_name}({NAME})(?={gap}*\.{gap}*$)", f"$1{_PART}'$2")
    x = F.regexp_replace(x, rf"(?md)^ {{0,7}}({NAME}){gap}+SECTION(?:{gap}+[0-9]+)?{gap}*\.[^\n]*", f"{_WING}'$1.")
    x = F.regexp_replace(F.regexp_replace(x, _VERB, _EDGE + "$1"), r"\.(?=\s|\z)", f"{_STOP}{_EDGE}")
    x = F.regexp_replace(x, rf"{_EDGE}(?= *(?:\n|\z))", "")  # what begins on no line of its own goes on with what is before
    x = within(x, "\n", lambda line, i: F.regexp_replace(line, f"({marks})", F.concat(F.lit("$1"), (i + 1).cast("string"), F.lit(_HEAD))), "\n")
    over = rf"(?![^\s{_EDGE}{_STOP}{_PART}{_WING}])"  # a word ends here
    exec_ = rf"(?s){_EDGE}[0-9]+{_HEAD}EXEC{over}.*?(?={_EDGE}[0-9]+{_HEAD}END-EXEC{over}|\z)"

    def whole(t: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(F.substr(t, F.lit(2)), rf"{_STOP}[0-9]+{_HEAD}", "\n.\n"), rf"{marks}[0-9]+{_HEAD}'?", "\n")
        return F.concat(F.substr(t, F.lit(1), F.lit(1)), inner)

    x = bound(x, lambda t: F.when(F.contains(t, F.lit(_HEAD + "EXEC")), swapped(t, exec_, lambda h: F.when(h != "", whole(h)).otherwise(h))).otherwise(t))
    x = within(x, _STOP, lambda t, i: F.regexp_replace(t, f"({marks})", F.concat(F.lit("$1"), i.cast("string"), F.lit(","))), _STOP)
    x = F.regexp_extract(x, rf"(?s){_EDGE}[0-9]+,[0-9]+{_HEAD}PROCEDURE(?= +DIVISION).*", 0)
    opens, ends = (rf"(?<={_EDGE}{{tail}}{_HEAD}{e}(?:IF|EVALUATE|SEARCH)){over}" for e in ("", "END-"))

    def numbered(t: Column, cut: str) -> Column:
        """Behind each mark of a statement how many cuts are before it."""
        return within(t, cut, lambda z, i: F.regexp_replace(z, f"([{_EDGE}{_WING}])", F.concat(F.lit("$1"), i.cast("string"), F.lit(","))), "")

    def sentence(t: Column) -> Column:
        two = "[0-9]{1,9},[0-9]{1,9}"
        return F.when(t.rlike(rf"{_HEAD}(?:IF|EVALUATE|SEARCH)"), numbered(numbered(t, opens.format(tail=two)), ends.format(tail="[0-9]{1,9}," + two))).otherwise(F.regexp_replace(t, f"([{_EDGE}{_WING}])", "$10,0,"))

    x = within(x, _STOP, lambda t, i: sentence(t), _STOP)
    # a section knows the paragraph before it
    x = within(x, _PART, lambda t, i: F.replace(t, F.lit(_WING), F.concat(F.lit(_WING), i.cast("string"), F.lit(","), F.when(i > 0, F.regexp_extract(t, rf"{_HEAD}'({NAME})", 1)).otherwise(""), F.lit(","))), _PART)

    def row(head: Column, verb: Column | str, body: Column, section: Column, paragraph: Column, place: Column, conditional: Column | None = None) -> Column:
        line, sentence = F.element_at(head, -1).cast("int"), F.element_at(head, -2).cast("long")
        return F.struct(line.alias("line"), section.alias("section"), paragraph.alias("paragraph"), place.alias("place"), sentence.alias("sentence"), (F.lit(verb) if isinstance(verb, str) else verb).alias("verb"), body.alias("body"), (F.lit(False) if conditional is None else conditional).alias("conditional"))

    def head(t: Column) -> Column:
        return F.split(F.substring_index(t, _HEAD, 1), ",")

    def name(t: Column) -> Column:
        return F.regexp_extract(t, rf"{_HEAD}'({NAME})", 1)

    def plain(section: Column, paragraph: Column, place: Column) -> Callable[[Column], Column]:
        def one(t: Column) -> Column:
            said = F.trim(F.regexp_replace(F.substring_index(F.substring_index(t, _STOP, 1), _HEAD, -1), r" *(?:\n *)+", " "))
            return bound(said, lambda s: bound(F.regexp_extract(s, r"^(\S+)", 1), lambda verb: bound(head(t), lambda h: row(
                h, verb, F.trim(F.regexp_replace(F.translate(s, _BLANK + _DOT, " ."), r"^\S+", "")), section, paragraph, place,
                (F.get(h, F.lit(1)).cast("int") > F.get(h, F.lit(0)).cast("int")) & ~verb.isin("END-IF", "END-EVALUATE", "END-SEARCH")))))
        return one

    def pieces(t: Column, section: Column, paragraph: Column, place: Column) -> Column:
        """The statements of a part, without what stands before its first mark."""
        def wanted(z: Column) -> Column:
            if verbs:
                return z.rlike(rf"{_HEAD}[ \n]*(?:{'|'.join(verbs)})(?=\s|{_STOP}|\z)")
            return ~z.rlike(rf"^[^{_HEAD}]*{_HEAD}[ \n]*\.?(?:{_STOP}|\z)")

        some = bound(F.split(t, _EDGE), lambda cut: F.filter(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), wanted))
        return F.transform(some, plain(section, paragraph, place))

    def part(section: Column, before: Column, base: Column) -> Callable[[Column, Column], Column]:
        def one(t: Column, i: Column) -> Column:
            place = (base + i).cast("long")
            return F.when(i == 0, pieces(t, section, before, place)).otherwise(bound(name(t), lambda n: F.concat(F.array(bound(head(t), lambda h: row(h, "LABEL", n, section, n, place))), pieces(t, section, n, place))))
        return one

    def wing(t: Column, i: Column) -> Column:
        none = F.lit(None).cast("string")
        first = F.flatten(F.transform(F.split(t, _PART), part(none, none, F.lit(0))))

        def other(h: Column) -> Column:
            before, base = F.nullif(F.get(h, F.lit(1)), F.lit("")), F.get(h, F.lit(0)).cast("int")
            return bound(name(t), lambda n: F.concat(F.array(row(h, "SECTION", n, n, before, base.cast("long"), F.get(h, F.lit(3)).cast("int") > F.get(h, F.lit(2)).cast("int"))), F.flatten(F.transform(F.split(t, _PART), part(n, before, base)))))

        return F.when(i == 0, first).otherwise(bound(head(t), other))

    return F.flatten(F.transform(F.split(x, _WING), wing))


#: The verbs that control flow depends on.
STEERING = ("PROCEDURE", "LABEL", "SECTION", "IF", "EVALUATE", "SEARCH", "PERFORM", "GO", "GOBACK", "STOP", "EXIT")


def _flow(st: DataFrame, key: str) -> DataFrame:
    """A row for each source with its paragraphs by place: key, places; of a paragraph the statements that can be reached count.

    A paragraph has name, section, barrier (control does not fall through), ends (the program), conditions, jumps (labels) and performs (label and thru).
    """
    verb, body = F.col("verb"), F.col("body")
    leaves = ~F.col("conditional") & (((verb == "GO") & ~F.contains(body, F.lit("DEPENDING"))) | (verb == "GOBACK") | ((verb == "STOP") & F.startswith(body, F.lit("RUN"))) | ((verb == "EXIT") & F.startswith(body, F.lit("PROGRAM"))))
    condition = verb.isin("IF", "EVALUATE", "SEARCH") | (F.contains(body, F.lit("UNTIL ")) & (verb == "PERFORM"))
    words = F.split(F.regexp_replace(F.regexp_replace("body", r"^TO\s+", ""), r"\s+DEPENDING.*$", ""), r"[\s,]+")
    range_ = F.struct(*(F.regexp_extract("body", rf"^({NAME})(?:\s+(?:THRU|THROUGH)\s+({NAME}))?", g).alias(x) for g, x in ((1, "label"), (2, "thru"))))
    said = F.struct("n", leaves.alias("leaves"), (leaves & (verb != "GO")).alias("ends"), condition.alias("condition"), F.when(verb == "GO", words).alias("jumps"), F.when(verb == "PERFORM", range_).alias("performs"), "section")
    rows = st.where(verb.isin(*STEERING)).select(key, "place", "paragraph", said.alias("s"))

    def place(all_: Column) -> Column:
        at = F.array_position(F.transform(all_, lambda s: s["leaves"]), True)  # nothing behind it is reached
        return bound(F.when(at > 0, F.slice(all_, F.lit(1), at.cast("int"))).otherwise(all_), lambda alive: F.struct(
            F.col("place"), F.col("name"), F.array_max(F.transform(alive, lambda s: s["section"])).alias("section"), F.exists(alive, lambda s: s["leaves"]).alias("barrier"), F.exists(alive, lambda s: s["ends"]).alias("ends"),
            F.size(F.filter(alive, lambda s: s["condition"])).cast("long").alias("conditions"), F.flatten(F.transform(F.filter(alive, lambda s: s["jumps"].isNotNull()), lambda s: s["jumps"])).alias("jumps"),
            F.transform(F.filter(alive, lambda s: s["performs"].isNotNull()), lambda s: s["performs"]).alias("performs")))

    places = rows.groupBy(key, "place").agg(F.max("paragraph").alias("name"), F.array_sort(F.collect_list("s")).alias("a")).select(key, place(F.col("a")).alias("p"))
    return places.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("places"))


def _labels(places: Column) -> Column:
    """A map from the labels of a source to the places that they span; a paragraph goes before a section of its name, and its first place counts."""
    def bounds(x: Column, step: int) -> Column:
        """Of structs in order, the first (step -1) or the last (1) of each label."""
        return F.filter(x, lambda z, i: F.coalesce(F.get(x, i + step)["label"] != z["label"], F.lit(True)))

    def of(column: str) -> Column:
        return F.array_sort(F.transform(F.filter(places, lambda p: p[column].isNotNull() & ((p["place"] > 0) if column == "section" else F.lit(True))), lambda p: F.struct(p[column].alias("label"), p["place"].alias("place"))))

    def entry(label: Column, first: Column, last: Column) -> Column:
        return F.struct(label.alias("label"), F.struct(first.alias("first"), last.alias("last")).alias("span"))

    spans = bound(of("name"), lambda x: F.map_from_entries(F.transform(bounds(x, -1), lambda z: entry(z["label"], z["place"], z["place"]))))
    wide = bound(of("section"), lambda x: F.transform(F.arrays_zip(bounds(x, -1).alias("a"), bounds(x, 1).alias("b")), lambda z: entry(z["a"]["label"], z["a"]["place"], z["b"]["place"])))
    return bound(spans, lambda s: F.map_concat(s, F.map_from_entries(F.filter(wide, lambda z: F.try_element_at(s, z["label"]).isNull()))))


def control_flow(st: DataFrame, key: str) -> DataFrame:
    """A path for each range that is performed: path_id, entry_point, last_point, paragraphs (in the source's order), exit_points, called_paragraphs, conditions, loops, complexity.

    Control runs on from the entry through paragraphs and jumps until the range's last paragraph ends, a statement ends
    the program, or the source does.  What falls through is one interval of places, so a round follows a jump, not a paragraph.
    st: all statements of each source.  They are grouped by source once; rows of sources that are dealt by their key are not shuffled again.
    """
    def resolved(places: Column, labels: Column) -> Column:
        """The paragraphs with the places of their jumps and the ranges that they perform, and where falling through from each ends."""
        def known(p: Column) -> Column:
            jumps = F.array_distinct(F.transform(F.filter(F.transform(p["jumps"], lambda j: F.try_element_at(labels, j)), lambda z: z.isNotNull()), lambda z: z["first"]))
            ranges = F.transform(p["performs"], lambda f: bound(F.try_element_at(labels, f["label"]), lambda z: F.when(
                z.isNotNull(), F.struct(z["first"].alias("first"), F.coalesce(F.try_element_at(labels, f["thru"])["last"], z["last"]).alias("last"), f["label"].alias("entry")))))
            return F.struct(p["name"].alias("name"), p["place"].alias("place"), p["barrier"].alias("barrier"), p["ends"].alias("ends"), p["conditions"].alias("conditions"), jumps.alias("jumps"), F.array_compact(ranges).alias("ranges"))

        return F.transform(places, known)

    def until(places: Column) -> Column:
        """For each place the next one that control does not fall through, or the last: each barrier stands for those since the one before it."""
        bars = F.transform(F.filter(places, lambda p, i: p["barrier"] | (i == F.size(places) - 1)), lambda p: p["place"])
        return F.flatten(F.transform(bars, lambda b, i: F.array_repeat(b, (b - F.when(i > 0, F.get(bars, i - 1)).otherwise(F.lit(-1))).cast("int"))))

    def paths(places: Column, stops: Column) -> Column:
        ranges = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda p: p["ranges"]))))
        size = F.size(places) - 1

        def at(x: Column, place: Column) -> Column:
            return F.get(x, place.cast("int"))

        def path(r: Column, number: Column) -> Column:
            def end(start: Column) -> Column:
                return F.when(start <= r["last"], F.least(at(stops, start), r["last"])).otherwise(at(stops, start))

            def run(start: Column) -> Column:
                return F.sequence(start, end(start))

            def further(s: Column, _: Column) -> Column:
                to = F.array_distinct(F.flatten(F.transform(s["front"], lambda f: F.flatten(F.transform(F.slice(places, f.cast("int") + 1, (end(f) - f).cast("int") + 1), lambda p: p["jumps"])))))
                return F.when(F.size(s["front"]) == 0, s).otherwise(bound(F.array_except(to, s["seen"]), lambda new: F.struct(new.alias("front"), F.concat(s["seen"], new).alias("seen"))))

            begin = F.struct(F.array(r["first"]).alias("front"), F.array(r["first"]).alias("seen"))
            rounds = F.sequence(F.lit(0), F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: p["jumps"])))))
            seen = F.aggregate(rounds, begin, further, lambda s: s["seen"])

            def told(covered: Column) -> Column:
                here = F.transform(covered, lambda c: at(places, c))
                out = F.filter(here, lambda p: p["ends"] | (p["place"] == r["last"]) | ((p["place"] == size) & ~p["barrier"]))
                called = F.array_sort(F.array_distinct(F.flatten(F.transform(here, lambda p: F.transform(p["ranges"], lambda f: f["entry"])))))
                back = F.exists(here, lambda p: F.exists(p["jumps"], lambda t: (t <= p["place"]) & F.array_contains(covered, t)))
                return F.struct(F.concat(F.lit("PATH_"), (number + 1).cast("string")).alias("path_id"), r["entry"].alias("entry_point"), at(places, r["last"])["name"].alias("last_point"), F.transform(here, lambda p: p["name"]).alias("paragraphs"),
                                F.transform(out, lambda p: p["name"]).alias("exit_points"), called.alias("called_paragraphs"), F.aggregate(here, F.lit(0).cast("long"), lambda n, p: n + p["conditions"]).alias("conditions"), back.alias("loops"), F.size(called).alias("complexity"))

            return bound(F.array_sort(F.array_distinct(F.flatten(F.transform(seen, run)))), told)

        firsts = bound(ranges, lambda x: F.filter(x, lambda r, i: F.coalesce((F.get(x, i - 1)["first"] != r["first"]) | (F.get(x, i - 1)["last"] != r["last"]), F.lit(True))))
        return F.transform(firsts, path)

    all_ = bound(F.col("places"), lambda x: bound(_labels(x), lambda labels: bound(resolved(x, labels), lambda places: bound(until(places), lambda stops: paths(places, stops)))))
    sources = _flow(st.withColumnRenamed(key, KEY), KEY)
    return sources.select(F.col(KEY).alias(key), F.explode(all_).alias("p")).select(key, "p.*")


#: Kinds of value flow: a letter for each.
FLOWS = {"MOVE": "M", "SET": "M", "COMPUTE": "C", "ADD": "A", "SUBTRACT": "A", "MULTIPLY": "A", "DIVIDE": "A", "STRING": "S", "UNSTRING": "S"}
#: Words in the operands of these statements that are no fields.
NO_FIELD = (
    "TO FROM BY INTO GIVING ROUNDED REMAINDER CORR CORRESPONDING SIZE DELIMITED POINTER WITH ALL OR TALLYING IN OF ON ERROR OVERFLOW NOT SPACE SPACES ZERO ZEROS ZEROES HIGH-VALUE HIGH-VALUES LOW-VALUE LOW-VALUES "
    "QUOTE QUOTES NULL NULLS TRUE FALSE FUNCTION LENGTH ADDRESS COUNT DELIMITER UP DOWN"
).split()


def _fields(text: Column) -> Column:
    """The fields that a piece of a statement names, without subscripts and qualifiers."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?<=[A-Z0-9])\s*\([^()]*\)", " "), rf"\s(?:OF|IN)\s+{NAME}", " ")
    words = F.regexp_extract_all(bare, F.lit(rf"(?<![A-Z0-9.-])({NAME})"), F.lit(1))
    return F.filter(F.array_distinct(words), lambda w: w.rlike("[A-Z]") & ~w.isin(*NO_FIELD))


def sorted_(rows: DataFrame) -> DataFrame:
    """One side of a join that is sorted, not broadcast: Spark takes rows made of a small file's for as small as the file, and the driver would hold them all."""
    return rows.hint("merge")


def value_flow(st: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """program, source, to_program, target, kind, line: values that go from field to field, within a program and through CALL USING.

    names: key and name, what programs are called by.  Arguments go to the parameters of PROCEDURE DIVISION USING at the same
    position (kind P), and back from parameters that the called program changes (R).
    """
    used = F.col("verb").isin(*FLOWS, "CALL", "PROCEDURE")
    st, names, key = kept(st.where(used).select(F.col(key).alias(KEY), "line", "verb", "body")), names.select(F.col(key).alias(KEY), "name"), KEY
    rows = st.where(F.col("verb").isin(*FLOWS))
    bare = F.regexp_replace("body", r"'[^']*'|\"[^\"]*\"", "0")
    text = F.regexp_replace(F.regexp_replace(bare, r"\s+(?:NOT\s+)?ON\s+(?:SIZE|OVERFLOW).*$", ""), r"\s*\.$", "")
    rows = rows.withColumn("body", text)
    cut = F.when(F.col("verb") == "COMPUTE", F.array(F.regexp_extract("body", r"^([^=]*)=(.*)$", 2), F.regexp_extract("body", r"^([^=]*)=(.*)$", 1)))
    giving = r"^(.*?)\sGIVING\s(.*)$"
    cut = cut.when(F.col("body").rlike(giving), F.array(F.regexp_extract("body", giving, 1), F.regexp_extract("body", giving, 2)))
    word = r"^(.*?)\s(?:TO|FROM|BY|INTO)\s(.*)$"
    cut = cut.otherwise(F.array(F.regexp_extract("body", word, 1), F.regexp_extract("body", word, 2)))
    rows = rows.select(key, "line", "verb", _fields(cut[0]).alias("s"), _fields(cut[1]).alias("t"))
    kind = F.create_map(*(F.lit(x) for pair in FLOWS.items() for x in pair))[F.col("verb")]
    own = rows.select(key, "line", kind.alias("kind"), F.explode("s").alias("source"), "t").select(key, "line", "kind", "source", F.explode("t").alias("target")).where("source <> target")
    own = own.select(F.col(key).alias("program"), "source", F.col(key).alias("to_program"), "target", "kind", "line")
    using = F.regexp_extract("body", r"(?:^|\s)USING\s+(.*?)(?:\s+RETURNING.*|\s*\.)?$", 1)
    listed = F.filter(F.split(F.regexp_replace(F.regexp_replace(using, r"'[^']*'|\"[^\"]*\"", "-"), r"\([^()]*\)", ""), r"[\s,]+"), lambda w: ~w.isin("", "BY", "REFERENCE", "CONTENT", "VALUE"))
    calls = st.where("verb = 'CALL'").select(F.col(key).alias("program"), "line", F.upper(F.regexp_extract("body", r"^['\"]?([^'\"\s]+)", 1)).alias("name"), F.posexplode(listed).alias("position", "argument")).where(F.col("argument").rlike("[A-Z]"))
    params = st.where("verb = 'PROCEDURE'").select(key, F.posexplode(listed).alias("position", "parameter")).join(sorted_(names.select(key, F.upper("name").alias("name"))), key)
    met = calls.join(sorted_(params.withColumnRenamed(key, "called")), ["name", "position"])
    there = met.select("program", F.col("argument").alias("source"), F.col("called").alias("to_program"), F.col("parameter").alias("target"), F.lit("P").alias("kind"), "line")
    changed = rows.select(F.col(key).alias("called"), F.explode("t").alias("parameter")).distinct()
    back = met.join(sorted_(changed), ["called", "parameter"], "left_semi").select(F.col("called").alias("program"), F.col("parameter").alias("source"), F.col("program").alias("to_program"), F.col("argument").alias("target"), F.lit("R").alias("kind"), "line")
    return own.union(there).union(back).distinct()


def lineage(flows: DataFrame, starts: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """program, field, to_program, to_field, hops, kinds: where the values of fields go by the shortest way, of equally short ones by the least kinds.

    starts: program and field; None: the fields that nothing goes to.  Each front is written and has what was not reached before.
    """
    steps = kept(flows.groupBy("program", F.col("source").alias("field"), "to_program", F.col("target").alias("to_field")).agg(F.min("kind").alias("kind")))
    ends = steps.select(F.col("to_program").alias("program"), F.col("to_field").alias("field")).distinct()
    starts = steps.select("program", "field").distinct().join(sorted_(ends), ["program", "field"], "left_anti") if starts is None else starts.select("program", "field").distinct()
    name, here = ["program", "field"], ["to_program", "to_field"]
    front = kept(starts.select(*name, F.col("program").alias("to_program"), F.col("field").alias("to_field"), F.lit("").alias("kinds")))
    known, hop = front.withColumn("hops", F.lit(0)), 0
    links = steps.select(F.col("program").alias("to_program"), F.col("field").alias("to_field"), F.col("to_program").alias("p"), F.col("to_field").alias("f"), "kind")
    while not front.isEmpty() and (max_hops is None or hop < max_hops):
        hop += 1
        more = front.join(sorted_(links), here).select(*name, F.col("p").alias("to_program"), F.col("f").alias("to_field"), F.concat("kinds", "kind").alias("kinds")).groupBy(*name, *here).agg(F.min("kinds").alias("kinds"))
        front = kept(more.join(sorted_(known), [*name, *here], "left_anti"))
        known = known.unionByName(front.withColumn("hops", F.lit(hop)))
    return known.where("hops > 0").select(*name, *here, "hops", "kinds")


#: Flows of messages by the calls that they need in this order.
MESSAGE_FLOWS = (
    ("request_reply", ("MQPUT", "MQGET")), ("fire_and_forget", ("MQPUT1",)), ("publish_subscribe", ("MQSUB", "MQGET")),
    ("persistent_messaging", ("MQOPEN", "MQPUT", "MQCLOSE")), ("transactional_messaging", ("MQBEGIN", "MQPUT", "MQCMIT")),
)
CONNECTS, MESSAGES, UNITS = ("MQCONN", "MQCONNX"), ("MQPUT", "MQPUT1", "MQGET"), ("MQBEGIN", "MQCMIT", "MQBACK")


def message_sequences(calls: DataFrame, key: str, order: list[str], api: str) -> DataFrame:
    """The calls of each source as sequences: key, sequence, type, calls, first, last (numbers of the calls in order).

    A sequence begins with a connection, or with a message after a unit of work; its type is the highest it reaches:
    general, connection, message, transaction.
    """
    calls, named, key = calls.withColumnRenamed(key, KEY), key, KEY
    w = Window.partitionBy(key).orderBy(*order)
    name = F.upper(api)
    kind = F.when(name.isin(*CONNECTS), "c").when(name.isin(*MESSAGES), "m").when(name.isin(*UNITS), "t")
    rows = calls.withColumns({"_api": name, "_kind": kind, "_at": F.row_number().over(w)})
    # Other calls go on with what there is; so what counts is the last of the three kinds before, and whether there is any call before.
    before = F.last("_kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("_at") == 1) | (F.col("_kind") == "c") | (F.col("_kind").isin("m", "t") & before.isNull()) | ((F.col("_kind") == "m") & (before == "t"))
    rows = rows.withColumn("_begins", F.coalesce(begins, F.lit(False))).withColumn("sequence", F.count_if(F.col("_begins")).over(w))
    found = rows.groupBy(key, "sequence").agg(F.array_sort(F.collect_list(F.struct("_at", "_api"))).alias("c"), F.max("_kind").alias("k"), F.min("_at").alias("first"), F.max("_at").alias("last"))
    kinds = F.when(F.col("k") == "t", "transaction_sequence").when(F.col("k") == "m", "message_sequence").when(F.col("k") == "c", "connection_sequence").otherwise("general_sequence")
    return found.select(F.col(key).alias(named), "sequence", kinds.alias("type"), F.col("c._api").alias("calls"), "first", "last")


def message_flows(calls: DataFrame, key: str, order: list[str], api: str) -> DataFrame:
    """Every flow of MESSAGE_FLOWS in the calls of each source: key, flow, match (number), first, last (numbers of its first and last call).

    Matches of a flow do not overlap; each begins at the first call that can begin it and ends at the first that ends it.
    MQPUT1 counts as an MQPUT, as its name begins with it.  An automaton of one step for each call runs over the source's calls.
    """
    named, key = key, KEY
    rows = calls.select(F.col(named).alias(key), F.row_number().over(Window.partitionBy(named).orderBy(*order)).alias("at"), F.upper(api).alias("api"))
    texts = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "api"))).alias("calls"))
    state = "struct<step:int,first:int,found:array<struct<first:int,last:int>>>"

    def matches(steps: tuple[str, ...]) -> Column:
        def move(s: Column, c: Column) -> Column:
            wanted = F.element_at(F.array(*map(F.lit, steps)), s["step"] + 1)
            hit = F.startswith(c["api"], wanted)
            first = F.when(s["step"] == 0, c["at"]).otherwise(s["first"])
            done = hit & (s["step"] + 1 == len(steps))
            return F.when(~hit, s).when(done, F.struct(F.lit(0).alias("step"), F.lit(0).alias("first"), F.concat(s["found"], F.array(F.struct(first.alias("first"), c["at"].alias("last")))).alias("found"))).otherwise(
                F.struct((s["step"] + 1).alias("step"), first.alias("first"), s["found"].alias("found"))).cast(state)

        begin = F.struct(F.lit(0).alias("step"), F.lit(0).alias("first"), F.array().cast("array<struct<first:int,last:int>>").alias("found")).cast(state)
        return F.aggregate("calls", begin, move, lambda s: s["found"])

    each = F.array(*(F.struct(F.lit(flow).alias("flow"), matches(steps).alias("found")) for flow, steps in MESSAGE_FLOWS))
    out = texts.select(key, F.explode(each).alias("e")).select(key, "e.flow", F.posexplode("e.found").alias("match", "f"))
    return out.select(F.col(key).alias(named), "flow", (F.col("match") + 1).alias("match"), "f.first", "f.last")
