"""Secret redaction as an ordered chain of ``regexp_replace`` steps.

Two modes share the rules.  ``line`` treats every line of a text by itself, as
bundles do: white space and wildcards then stop at ``\\n``, so a whole chunk is
rewritten in one pass per rule without splitting it.  ``text`` lets a match
span lines, which is what a direct call on a whole text means.

The patterns are written for Java's engine.  Its ``\\s`` and ``\\b`` differ from
the wanted Unicode meaning, so white space is spelled out and word boundaries
are look-arounds over letters, numbers and ``_``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions import paths
from bindery.functions.text import let

# The mark, white space inside a line, and line ends.
MARK = "<REDACTED>"
BLANKS = r"\t \x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"

# Words that announce a secret, by the notation they appear in.
JSON_WORDS = (
    r"api[_-]?key|token|secret|password|client[_-]?secret|access[_-]?token|"
    r"refresh[_-]?token|bearer|auth_token|private[_-]?key|credentials"
)
YAML_WORDS = JSON_WORDS + r"|secret[_-]?key|signing[_-]?key"
URL_WORDS = (
    "token|access_token|refresh_token|api_key|apikey|secret|sig|signature|auth|bearer|"
    "password|passwd|pwd"
)
ENV_WORDS = (
    "SECRET_KEY|API_KEY|PRIVATE_KEY|SIGNING_KEY|CLIENT_SECRET|API_SECRET|ACCESS_KEY|"
    "AUTH_TOKEN|BEARER_TOKEN|CREDENTIALS|TOKEN|PASSWORD|PASS|SIGNING_SECRET|API_PASSWORD|"
    "CLIENT_KEY"
)
HEADER_WORDS = "x-api-key|api-key|apikey|api_key"

# The only values of a YAML secret that stay.
YAML_EMPTY = r"""""|''|null|~"""

# Letters that a pattern without case takes for another letter.
OTHER_CASES = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
SIGNS = [":", "=", "_"]
ODD_LETTERS = ["\u017f", "\u0131", "\u0307"]


@dataclass(frozen=True)
class Rule:
    """A pattern, its replacement, and literals a match cannot do without.

    ``needs`` lists groups of literals; a match has one of each group.  Where
    ``any_case`` is set they are looked for in the lower-cased text.
    """

    name: str
    pattern: str
    replacement: str
    needs: tuple[tuple[str, ...], ...]
    any_case: bool = False


def _ahead(words: str) -> str:
    """A look-ahead for the first two letters of the words.

    Most positions fail it at once, which spares the engine the alternatives.
    """
    pairs = {(w[0], w[1]) for w in words.split("|")}

    def letters(chars) -> str:
        return "".join(sorted({x for c in chars for x in c.lower() + c.upper() + OTHER_CASES.get(c, "")}))

    return f"(?=[{letters(p[0] for p in pairs)}][{letters(p[1] for p in pairs)}])"


def _words(words: str) -> str:
    """Word group of a pattern that ignores case."""
    return f"{_ahead(words)}(?iu)"


def rules(mode: str = "line") -> list[Rule]:
    """The rules in the order they apply."""
    if mode not in ("line", "text"):
        raise ValueError(f"unknown redaction mode: {mode}")
    one_line = mode == "line"
    gap = f"[{BLANKS}]" if one_line else f"[{BLANKS}{LINE_ENDS}]"
    solid = f"[^{BLANKS}{LINE_ENDS}]"
    unquoted = r'[^"\n]' if one_line else '[^"]'
    anything = r"[^\n]" if one_line else r"[\s\S]"
    word = r"[\p{L}\p{N}_]"
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    any_case = "(?iu)"
    quote = "['\"]"
    b64, token = "[A-Za-z0-9+/]", r"[A-Za-z0-9_\-]"
    line_start, line_end = r"(?<![^\n])", r"(?![^\n])"
    word_parts = ("api", "token", "secret", "password", "bearer", "private", "credentials", "signing")

    return [
        Rule(
            "private_key_block",
            f"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----{anything}*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
            f"-----BEGIN PRIVATE KEY-----\n{MARK}\n-----END PRIVATE KEY-----",
            (("PRIVATE KEY-----",),),
        ),
        Rule(
            "bearer_header",
            rf"{_words('authorization')}(Authorization{gap}*:{gap}*Bearer{gap}+)[A-Za-z0-9\-_.=]+",
            f"$1{MARK}",
            ((":",), ("authorization",)),
            any_case=True,
        ),
        Rule(
            "bearer_json",
            f'{any_case}("Authorization"{gap}*:{gap}*")Bearer{gap}+{unquoted}+"',
            f'$1Bearer {MARK}"',
            ((":",), ('"authorization"',)),
            any_case=True,
        ),
        Rule(
            "api_key_header",
            f"{_words(HEADER_WORDS)}((?:{HEADER_WORDS})(?:[\":=]|{gap})+)"
            f"{quote}?[A-Za-z0-9_\\-.]{{8,}}{quote}?",
            f"$1{MARK}",
            (("api-key", "apikey", "api_key"),),
            any_case=True,
        ),
        Rule(
            "jwt",
            rf"(?=eyJ)(?<!{word})eyJ{token}{{10,}}\.{token}{{10,}}\.{token}{{10,}}{edge}",
            MARK,
            (("eyJ",),),
        ),
        Rule("aws_key", "AKIA[0-9A-Z]{16}", MARK, (("AKIA",),)),
        Rule(
            "github_token",
            "gh[pousr]_[A-Za-z0-9_]{36,251}",
            MARK,
            (("_",), ("gh",)),
        ),
        Rule(
            "slack_token",
            "xox[bpors]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*",
            MARK,
            (("xox",),),
        ),
        Rule("google_key", rf"AIza{token}{{35}}", MARK, (("AIza",),)),
        Rule("stripe_key", "sk_live_[0-9a-zA-Z]{24,}", MARK, (("sk_live_",),)),
        Rule("twilio_key", "SK[0-9a-fA-F]{32}", MARK, (("SK",),)),
        Rule(
            "json_secret",
            f'{any_case}("(?:{JSON_WORDS})"{gap}*:{gap}*)"{unquoted}*"',
            f'$1"{MARK}"',
            ((":",), ('"',), word_parts),
            any_case=True,
        ),
        Rule(
            "yaml_secret",
            f"{_words(YAML_WORDS)}({YAML_WORDS}){gap}*:{gap}*(?!(?:{YAML_EMPTY})(?!{solid})){solid}+",
            f"$1: {MARK}",
            ((":",), word_parts),
            any_case=True,
        ),
        Rule(
            "url_secret",
            f"{_ahead(URL_WORDS)}(?<!{word})(?iu)((?:{URL_WORDS})=)[^&\"{BLANKS}{LINE_ENDS}]+",
            f"$1{MARK}",
            (("=",), tuple(f"{w}=" for w in URL_WORDS.split("|"))),
            any_case=True,
        ),
        Rule(
            "base64_secret",
            f"{_words('secret|private|signing')}((?:secret|private|signing)[_-]?key(?:_[a-z]+)?)"
            f"{gap}*={gap}*{quote}{b64}{{20,}}={{0,2}}{quote}",
            f'$1="{MARK}"',
            (("=",), ("key",), ("secret", "private", "signing"), ("'", '"')),
            any_case=True,
        ),
        Rule(
            "hex_secret",
            f"{_words('secret|token|password|auth')}"
            "((?:secret|token|password|auth)[_-]?(?:key|value|hash|secret)?)"
            f"{gap}*={gap}*{quote}[0-9a-f]{{32,}}{quote}",
            f"$1='{MARK}'",
            (("=",), ("secret", "token", "password", "auth"), ("'", '"')),
            any_case=True,
        ),
        # The value is quoted when it starts and ends with the same quote; a
        # blank value cannot match because the possessive gap eats all of it.
        Rule(
            "env_secret",
            f"{line_start}{gap}*(?:export{gap}+)?((?:{ENV_WORDS})[A-Z0-9_]*){gap}*={gap}*+"
            rf"(?:(\")(?:[^\n]*\")?[{BLANKS}]*{line_end}|(')(?:[^\n]*')?[{BLANKS}]*{line_end}|[^\n]+)",
            f"$1=$2$3{MARK}$2$3",
            (("=",), ("KEY", "SECRET", "TOKEN", "CREDENTIALS", "PASS")),
        ),
    ]


def _lowered(text: Column) -> Column:
    """The lower-cased text, and whether it holds letters that case rules treat oddly."""
    low = F.lower(text)
    odd = paths.any_of(F.contains(low, F.lit(c)) for c in ODD_LETTERS)
    signs = [F.contains(text, F.lit(sign)).alias(sign) for sign in SIGNS]
    return F.struct(low.alias("low"), odd.alias("odd"), *signs)


def _gate(rule: Rule, text: Column, lowered: Column) -> Column:
    """Whether a text has the literals of a rule; false only if it cannot match."""
    side = lowered["low"] if rule.any_case else text

    def one_of(group: tuple[str, ...]) -> Column:
        if len(group) == 1 and group[0] in SIGNS:
            return lowered[group[0]]
        return paths.any_of(F.contains(side, F.lit(n)) for n in group)

    has = reduce(lambda a, b: a & b, [one_of(group) for group in rule.needs])
    return has | lowered["odd"] if rule.any_case else has


def _apply(rule: Rule, gate: Column):
    def rewrite(text: Column) -> Column:
        done = F.regexp_replace(text, rule.pattern, rule.replacement)
        return F.when(gate, done).otherwise(text)

    return rewrite


def redact(text: Column, mode: str = "line") -> Column:
    """The text with secrets replaced; null becomes the empty text.

    Replacements add no literal that a later rule needs, so the gates look at the
    original text.
    """
    steps = rules(mode)

    def rewrite(lowered: Column) -> Column:
        out = text
        for rule in steps:
            out = let(out, _apply(rule, _gate(rule, text, lowered)))
        return out

    return F.coalesce(let(_lowered(text), rewrite), F.lit(""))


def added_lines(text: Column) -> Column:
    """Lines that redaction per line adds: two for each key block within a line."""
    rule = rules("line")[0]
    blocks = F.regexp_count(text, F.lit(rule.pattern)) * rule.replacement.count("\n")
    return F.when(F.contains(text, F.lit(rule.needs[0][0])), blocks).otherwise(0)


def may_match(text: Column, mode: str = "line") -> Column:
    """False only for texts that no rule can change."""
    return let(
        _lowered(text), lambda low: paths.any_of(_gate(rule, text, low) for rule in rules(mode))
    )


def rule_hits(df: DataFrame, text: str, mode: str = "line") -> DataFrame:
    """How often each rule applies, one row per rule with any hit.

    Every rule sees the output of the rules before it.  The stages are separate
    projections: a pattern counts once in each text that has the rule's literals, and
    replaces once where it was found.  Nothing is filtered by the gates, as a filter
    would be pushed below the texts and compute both twice.
    """
    steps = rules(mode)
    content = F.col("_text")
    stage = df.select(F.col(text).alias("_text")).withColumn(
        "_gates", let(_lowered(content), lambda low: F.array(*[_gate(rule, content, low) for rule in steps]))
    )
    for i, rule in enumerate(steps):
        hits = "_n_" + rule.name
        stage = stage.withColumn(
            hits, F.when(F.get("_gates", F.lit(i)), F.regexp_count("_text", F.lit(rule.pattern))).otherwise(0)
        ).withColumn("_text", _apply(rule, F.col(hits) > 0)(content))
    counts = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_no"),
                F.lit(rule.name).alias("rule"),
                F.col("_n_" + rule.name).alias("hits"),
            )
            for i, rule in enumerate(steps, 1)
        ]
    )
    return (
        stage.select(F.explode(F.filter(counts, lambda c: c["hits"] > 0)).alias("c"))
        .groupBy("c.rule_no", "c.rule")
        .agg(F.sum("c.hits").alias("hits"), F.count("*").alias("texts"))
    )
