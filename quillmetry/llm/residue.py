"""Template residue and error-page text (problem 5).

Placeholders are found by one small grammar per delimiter, filler text by runs of filler words, error and script
notices by lines that consist of the notice. Code blocks (closed fences only: a stray fence hides nothing) and inline
code are blanked first. Placeholders right after words that talk about template syntax are discounted one by one
(context); a text in which half of the placeholders are, and in which such words are TALK of all words or more (density),
is a tutorial, and none of its placeholders counts.
Prose that only mentions a 404 error, lorem ipsum or JavaScript never forms a whole notice line or a filler run.

All rules are column expressions over the whole text, with cheap containment tests before the regular expressions.

Defined results: null, empty and blank texts are no case. Repeated rows give repeated rows in `residue`, one in
`found_residue`. Extra columns pass through `residue` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_][\w.\- ]*"
#: A grammar for each pair of delimiters: what must occur in the text, and the placeholder itself.
PLACEHOLDERS = {
    "double_brace": ("{{", r"\{\{\{?[#/^&>]? ?" + _NAME + r"(?:\|[^{}\n]*)? ?\}\}"),
    "brace_percent": ("{%", r"\{%-? ?[a-z]+[^%\n]*-?%\}"),
    "dollar_brace": ("${", r"\$\{ ?" + _NAME + r"\}"),
    "hash_brace": ("#{", r"#\{ ?" + _NAME + r"\}"),
    "brace": ("{", r"(?<![{$#%\w])\{[a-z][a-z]*(?:_[a-z0-9]+)*\}(?!\})"),
    "angle_percent": ("<%", r"<%[=\-]? ?[^%\n]+%>"),
    "percent_name": ("%(", r"%\([A-Za-z_]\w*\)[sdif]"),
    "percent_pair": ("%", r"(?<![\w%])%{1,2}[A-Z][A-Z_]{2,}%{1,2}"),
    "underscores": ("__", r"(?<![\w])__[A-Z][A-Z_]+__(?!\w)"),
    "bars": ("|", r"(?:\|[A-Z][A-Z_]{2,}\||\*\|[A-Z][A-Z_:]{2,}\|\*)"),
    "double_bracket": ("[[", r"\[\[[^\[\]\n]+\]\]"),
    "bracket": ("[", r"\[(?:INSERT|TK|TKTK|PLACEHOLDER|NAME|DATE|CITY|YOUR|Your|Insert|insert|ADD|TBD|XX)(?: [^\[\]\n]+)?\]|\[object Object\]"),
    "angle": ("<", r"<[A-Z]{3,}_\d+>|<(?:INSERT|NAME|PLACEHOLDER)[A-Z _]*>"),
    "blank_date": ("XX/", r"\bXX/XX/XX(?:XX)?\b"),
    "copy_marks": ("TK", r"\bTK(?: TK)+\b|\bDek TK\b|\bTKTK\b"),
}
#: Words of filler text.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud laboris nisi aliquip duis aute irure voluptate velit esse cillum fugiat nulla pariatur excepteur occaecat cupidatat proident culpa deserunt mollit".split()
FILLER_RUN = r"(?i)\b(?:(?:" + "|".join(FILLER) + r")\b[\s.,;]+){4,}"
#: Whole lines of text that someone forgot to replace.
STOCK_LINES = [
    r"body copy goes here", r"(?:this is )?(?:a )?test post(?:,)? please ignore", r"asdf asdf\b.*", r"this is a sample (?:story|post|page)\b.*",
    r".*replace this text with your own words.*", r"type or paste your (?:paragraph|text) here\b.*", r"(?:headline|title|caption|text|your text|content) goes here", r"(?:add|insert) (?:your )?(?:text|title|caption) here", r"dummy text", r"placeholder text",
]
#: Whole lines that a server, a wall or a script wrote instead of a story.
NOTICE_LINES = [
    r"(?:error )?[45]\d\d[ :\-]{1,3}(?:not found|bad gateway|forbidden|internal server error|service (?:temporarily )?unavailable|gateway time-?out|bad request|unauthorized|gone|too many requests)\b.*",
    r"(?:404|403|500|502|503)(?: error)?", r"page not found", r"error establishing a database connection", r"access denied", r"forbidden", r"service unavailable", r"\[(?:http_error|redirect|error)[:\]].*",
    r"the page you (?:are looking for|requested) (?:was|could|has|is|cannot|does)\b.*", r"you (?:do not|don't) have permission to (?:view|access)\b.*", r"too many requests\b.*",
    r"(?:oops!? )?something went wrong\b.*", r"oops!.*", r"(?:unfortunately,? )?this content is not available in your (?:region|country|area)\b.*", r"verify (?:that )?you are (?:a )?human\b.*",
    r"checking (?:if the site|your browser)\b.*", r".{0,80}needs to review the security of your connection\b.*", r"this takes a few seconds\b.*", r"loading(?:\.{2,}|…)?", r"please wait(?:\.{2,}|…)?", r"just a moment(?:\.{2,}|…)?",
    r"(?:uncaught )?(?:type|reference|syntax|range)error: .*", r"at [\w$.<>]+ \([\w./:\-]+:\d+:\d+\)", r"traceback \(most recent call last\):.*", r"fatal error: .*", r"warning: (?:mysqli?|include|require)\w*\(.*",
    r"</?noscript>.*", r"(?:please |bitte )?(?:enable|activate|turn on|aktivieren sie|active|activa|activez|habilite) (?:the )?(?:javascript|java script|scripts|cookies)\b.*", r"you need to (?:turn on|enable|activate) (?:scripts|javascript)\b.*",
    r"(?:this|the) (?:site|page|app|website) (?:works only|requires|needs)\b.{0,20}(?:scripts|javascript)\b.*", r"javascript (?:is|must be) (?:disabled|required|enabled|not enabled)\b.*", r"(?:your browser|javascript) .{0,30}(?:does not support|is not supported|is disabled)\b.*",
]
_CODE = r"(?s)```.*?```|(?<!`)`[^`\n]+`(?!`)|<(?:code|pre)\b.*?</(?:code|pre)>"
_TUTORIAL = r"(?i)\b(?:template (?:syntax|tag|engine|language|variable)s?|placeholder (?:syntax|like|such as|named)|merge tags? (?:like|such as)|variables? (?:like|such as|named)|the (?:literal|string|token|tag|marker|macro) )[^\n]{0,40}$"
#: Words that talk about templates, and the share of all words from which on they make a text a tutorial.
_TALK = r"(?i)\b(?:templates?|placeholders?|merge tags?|variables?|syntax|markup|macros?|snippets?|tokens?)\b"
TALK = 0.02


def _lines(patterns: list[str]) -> str:
    return r"(?im)^[ \t]*(?:" + "|".join(patterns) + r")[ \t]*$"


def residue(records: DataFrame, text: str) -> DataFrame:
    """Add has_placeholder, has_filler, has_stock, has_notice, placeholders (their number) and is_residue."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = records.withColumn("_t", F.when(t.contains("`") | t.contains("<code") | t.contains("<pre"), F.regexp_replace(t, _CODE, " ")).otherwise(t))
    t = F.col("_t")
    mention = lambda p: F.regexp_count(t, F.lit(p))
    count = F.lit(0)
    for needle, pattern in PLACEHOLDERS.values():
        count = count + F.when(t.contains(needle), mention(pattern)).otherwise(0)
    discussed = F.lit(0)
    for needle, pattern in PLACEHOLDERS.values():
        talk = _TUTORIAL[:-1].replace(r"[^\n]{0,40}", r"[^\n{}\[\]<>%|]{0,40}") + "[\"'“‘]?(?-i:" + pattern + ")"
        discussed = discussed + F.when(t.contains(needle), mention(talk)).otherwise(0)
    words = F.size(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "))
    counts = F.struct(count.alias("all"), discussed.alias("discussed"))
    out = out.withColumn("_n", F.element_at(F.transform(F.array(counts), lambda c: F.when(c["all"] == 0, 0).when((c["discussed"] * 2 >= c["all"]) & (mention(_TALK) >= TALK * words), 0).otherwise(c["all"] - c["discussed"])), 1))
    out = out.withColumns({"placeholders": F.col("_n"), "has_filler": t.rlike(FILLER_RUN), "has_stock": t.rlike(_lines(STOCK_LINES)), "has_notice": t.rlike(_lines(NOTICE_LINES))})
    out = out.withColumn("has_placeholder", F.col("placeholders") > 0)
    return out.withColumn("is_residue", F.col("has_placeholder") | F.col("has_filler") | F.col("has_stock") | F.col("has_notice")).drop("_t", "_n")


def found_residue(articles: DataFrame) -> DataFrame:
    """Distinct id of articles that are, or contain, residue."""
    return residue(articles.select("id", "clean_text"), "clean_text").filter("is_residue").select("id").distinct()
