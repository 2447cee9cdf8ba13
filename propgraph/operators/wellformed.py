"""Whether query texts hang together, as column code: clauses in order, brackets in pairs, no name used that is not bound.

This is wider than the bounded language of `grammar` (several hops and clauses, arithmetic, CASE, UNWIND, WITH) and does not
build anything of a query: texts are blanked, the rest is split at clause words, and a fold over the clauses keeps
the set of names that are bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clause words, each with a letter, and words that are no names.
CLAUSES = {"OPTIONAL MATCH": "O", "MATCH": "M", "UNWIND": "U", "WITH": "H", "WHERE": "F", "RETURN": "R", "ORDER BY": "S", "SKIP": "K", "LIMIT": "L"}
WORDS = ("AND", "OR", "XOR", "NOT", "IN", "IS", "NULL", "TRUE", "FALSE", "AS", "DISTINCT", "CONTAINS", "STARTS_WITH", "ENDS_WITH", "CASE", "WHEN", "THEN", "ELSE", "END", "ASC", "DESC", "ASCENDING", "DESCENDING", "EXISTS")
#: The order of clauses.
SHAPE = r"^(?:[MO]F?|U|HS?K?L?F?)*RS?K?L?$"
#: Brackets within brackets that are looked into, and the mark of what is left of a pair.
DEPTH, PAIR = 8, "¤"
#: What stands for a text.
TEXT = "§"

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_NODE = rf"\(\s*(?:{_NAME})?\s*(?::\s*{_NAME}(?:\s*[:|]\s*{_NAME})*)?\s*\)"
_REL = rf"(?:<-|-)\s*(?:\[\s*(?:{_NAME})?\s*(?::\s*{_NAME}(?:\s*\|\s*:?{_NAME})*)?\s*(?:\*[0-9]*(?:\.\.[0-9]*)?)?\s*\]\s*)?(?:->|-)"
_CHAIN = rf"(?:{_NAME}\s*=\s*)?{_NODE}(?:\s*{_REL}\s*{_NODE})*"
PATTERN = rf"^\s*{_CHAIN}(?:\s*,\s*{_CHAIN})*\s*$"
_HOPS = rf"{_NODE}(?:\s*{_REL}\s*{_NODE})+"
#: In an expression whose words are signs: an operator that lacks an operand, two of them, and two operands side by side.
_BROKEN = (r"(?:^|[,(\[])\s*[=<>+*/%]", r"[=<>+*/%,-]\s*(?:$|[,)\]])", r"(?:[+*/%]|(?<![<>!])=)\s*[=+*/%<>]", rf"[\w{TEXT}{PAIR}]\s+[\w{TEXT}{PAIR}]|{TEXT}[\w{TEXT}{PAIR}]|{PAIR}[\w{TEXT}]")
#: Words as signs, for that: (pattern, sign).
_SIGNS = (
    (r"\bIS (?:NOT )?NULL\b|\bDISTINCT\b|\b(?:ASC|DESC|ASCENDING|DESCENDING)\b|\bAS [A-Za-z_][A-Za-z0-9_]*|:\s*[A-Za-z_][A-Za-z0-9_]*", " "), (r"\bCASE(?: WHEN)?\b|\bEND\b", " "), (r"\b(?:WHEN|THEN|ELSE)\b", ","),
    (r"\b(?:AND|OR|XOR|IN|CONTAINS|STARTS_WITH|ENDS_WITH)\b", "+"), (r"\bNOT\b", "-"), (r"(^|[(,])\s*\*\s*($|[),])", "$1x$2"),
)


def blanked(query: Column) -> Column:
    """The query with a mark for each text, one blank for each run of them, and no semicolon at its end."""
    texts = F.regexp_replace(query, r"(?s)'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", TEXT)
    return F.trim(F.regexp_replace(F.regexp_replace(texts, r"\s+", " "), r"\s*;\s*$", ""))


def clauses(query: Column) -> Column:
    """array<struct<kind, body>> of a blanked query; what stands before the first clause word has no kind."""
    held = F.regexp_replace(query, r"(?i)\b(STARTS|ENDS) WITH\b", "$1_WITH")
    cut = F.split(F.regexp_replace(held, rf"(?i)\b({'|'.join(CLAUSES)})\b", "\u0001$1"), "\u0001")
    word = F.create_map(*(F.lit(x) for pair in CLAUSES.items() for x in pair))
    found = F.transform(F.filter(cut, lambda c: F.trim(c) != ""), lambda c: F.struct(F.upper(F.regexp_extract(c, rf"(?i)^({'|'.join(CLAUSES)})\b", 1)).alias("word"), c.alias("text")))
    return F.transform(found, lambda c: F.struct(F.coalesce(word[c["word"]], F.lit("?")).alias("kind"), F.trim(F.substr(c["text"], F.length(c["word"]) + 1)).alias("body")))


def flat(body: Column) -> Column:
    """A clause with a mark for each pair of outer brackets, and for patterns as conditions; brackets that do not pair stay."""
    out = F.regexp_replace(body, _HOPS, PAIR)
    for _ in range(DEPTH):
        out = F.regexp_replace(out, r"\([^()\[\]]*\)|\[[^()\[\]]*\]", PAIR)
    return out


def used(body: Column) -> Column:
    """The names that a clause refers to: what is no function, property, label, type or word of the language."""
    names = F.regexp_extract_all(F.regexp_replace(body, rf":\s*{_NAME}(?:\s*\|\s*:?{_NAME})*", ""), F.lit(rf"(?<![\w.$])({_NAME})(?!\w|\s*\()"), F.lit(1))
    return F.filter(F.array_distinct(names), lambda n: ~F.upper(n).isin(*WORDS))


def _items(left: Column) -> Column:
    """array<struct<name, plain, renamed>> of what WITH or RETURN gives, of a flat clause: by its AS, or as it stands."""
    bare = F.regexp_replace(left, r"(?i)^DISTINCT\b ?", "")
    return F.transform(F.split(bare, ","), lambda i: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(i, rf"(?i)\bAS ({_NAME})\s*$", 1), F.lit("")), F.trim(i)).alias("name"),
        F.trim(i).rlike(rf"^(?:{_NAME}|\*)$").alias("plain"), i.rlike(rf"(?i)\bAS {_NAME}\s*$").alias("renamed"),
    ))


def _signs(left: Column) -> Column:
    for words, sign in _SIGNS:
        left = F.regexp_replace(left, f"(?i){words}", sign)
    return F.trim(left)


def _read(parts: Column) -> Column:
    """The clauses with what the fold asks of each, every piece made once."""
    one = F.transform(parts, lambda c: F.struct(c["kind"].alias("kind"), c["body"].alias("body"), flat(c["body"]).alias("left")))
    two = F.transform(one, lambda c: F.struct(
        c["kind"].alias("kind"), c["body"].alias("body"), c["left"].alias("left"), _signs(c["left"]).alias("signs"), used(F.regexp_replace(c["body"], rf"(?i)\bAS {_NAME}", "")).alias("used"),
        F.when(c["kind"].isin("H", "R"), _items(c["left"])).alias("items"),
    ))

    def told(c: Column) -> Column:
        pattern = c["kind"].isin("M", "O")
        sound = ~c["left"].rlike(r"[()\[\]]")
        for broken in _BROKEN:
            sound = sound & ~c["signs"].rlike(broken)
        named = F.filter(F.transform(c["items"], lambda i: i["name"]), lambda n: n != "*")
        form = (
            F.when(pattern, c["body"].rlike(PATTERN))
            .when(c["kind"].isin("K", "L"), c["body"].rlike(r"^[0-9]+$"))
            .when(c["kind"] == "U", sound & c["body"].rlike(rf"(?i)\bAS {_NAME}$"))
            .when(c["kind"].isin("H", "R"), sound & (F.size(named) == F.size(F.array_distinct(named))) & ((c["kind"] == "R") | F.forall(c["items"], lambda i: i["plain"] | i["renamed"])))
            .otherwise(sound)
        )
        made = (
            F.when(pattern, F.regexp_extract_all(c["body"], F.lit(rf"(?:[(\[]\s*|^\s*|,\s*)({_NAME})\s*(?=[:)\]*=])"), F.lit(1)))
            .when(c["kind"] == "U", F.array(F.regexp_extract(c["body"], rf"(?i)\bAS ({_NAME})$", 1)))
            .when(c["kind"].isin("H", "R"), named)
            .otherwise(F.array().cast("array<string>"))
        )
        uses = F.when(pattern | c["kind"].isin("K", "L"), F.array().cast("array<string>")).otherwise(c["used"])
        fresh = (c["kind"] == "H") & ~F.exists(c["items"], lambda i: i["name"] == "*")  # only what WITH gives is bound after it
        return F.struct((form & (c["body"] != "")).alias("ok"), uses.alias("uses"), made.alias("made"), fresh.alias("fresh"))

    return F.transform(two, told)


def well_formed(query: Column) -> Column:
    """Whether a query text hangs together; null and blank ones do not.

    Clauses come in order and end in RETURN; patterns are chains of nodes and relations; brackets pair; no operator lacks
    an operand; every name used is bound by a pattern, UNWIND, WITH or (for ORDER BY) RETURN before; WITH names its
    expressions; and no two results have one name.
    """
    plain = blanked(query)
    parts = clauses(plain)
    shape = F.array_join(F.transform(parts, lambda c: c["kind"]), "").rlike(SHAPE)
    begin = F.struct(F.array().cast("array<string>").alias("bound"), F.lit(True).alias("ok"))

    def step(acc: Column, c: Column) -> Column:
        known = F.size(F.array_except(c["uses"], acc["bound"])) == 0
        bound = F.when(c["fresh"], c["made"]).otherwise(F.array_union(acc["bound"], c["made"]))
        return F.struct(bound.alias("bound"), (acc["ok"] & c["ok"] & known).alias("ok"))

    whole = F.aggregate(_read(parts), begin, step)["ok"]
    return F.coalesce(shape & ~plain.rlike("[\"'`]") & whole, F.lit(False))
