"""``url(...)`` references in style text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binding import let_struct, q, struct

_BLANKS = " \t\n\r\u000b\f"
# Lossless: a reference, or text without one.  Unclosed references run on.
URL_PIECES = r"(?s)url\([^)]*+(?:\)|\z)|(?:[^u]++|u(?!rl\())++"
URL_TOKEN = r"(?s)url\([^)]*+(?:\)|\z)"

# Tokens of a style sheet, each found in one pass over its own characters.
_SHEET_TOKEN = re.compile(
    r"""(?s)/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|url\([^)]*+(?:\)|\Z)|@[A-Za-z\-]++|[{}]|[^/"'u@{}]++|."""
)
# What stands between an at-keyword and the ``;`` or ``{`` that ends it.
_PRELUDE = re.compile(r"""(?s)(?:/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|\([^)]*+(?:\)|\Z)|[^;{}"'(/]++|["'/])*+""")
_URL_PIECE = re.compile(URL_PIECES.replace(r"\z", r"\Z"))
_RULE_LIKE = ("@font-face", "@page")


def split_sheet(text: str, nested: bool) -> list[str]:
    """Lossless pieces of a style sheet; those for which ``is_ref_sql`` holds
    are references of rule properties.

    Comments, statements such as ``@import`` and (unless ``nested``) blocks such
    as ``@media`` with the rules in them are pieces of their own.  Braces in
    strings and comments do not count, blocks nest to any depth, and one left
    open runs to the end, as does an at-rule without an end.
    """
    pieces: list[str] = []
    at, end = 0, len(text)
    while at < end:
        token = _SHEET_TOKEN.match(text, at).group()
        stop = at + len(token)
        if token[0] == "@" and len(token) > 1 and not token.lower().startswith(_RULE_LIKE):
            stop = _PRELUDE.match(text, stop).end()
            if stop < end and text[stop] == ";":
                stop += 1
            elif stop < end and text[stop] == "{" and not nested:
                depth = 0
                while stop < end:
                    inner = _SHEET_TOKEN.match(text, stop).group()
                    stop += len(inner)
                    depth += (inner == "{") - (inner == "}")
                    if not depth:
                        break
            pieces.append(text[at:stop])
        elif token[0] in "\"'" and len(token) > 1:
            # a property's string may hold a reference
            pieces += [m.group() for m in _URL_PIECE.finditer(token)]
        else:
            pieces.append(token)
        at = stop
    return pieces


# The same tokens for the JVM's regex engine; a statement at-rule (not one of
# _RULE_LIKE) takes its prelude and a closing ``;`` into its token.
_JVM_PRELUDE = r"""(?:/\*.*?(?:\*/|\z)|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|\([^)]*+(?:\)|\z)|[^;{}"'(/]++|["'/])*+"""
JVM_SHEET_TOKEN = (
    r"""(?s)/\*.*?(?:\*/|\z)|"(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|url\([^)]*+(?:\)|\z)"""
    r"""|@(?!(?i:font-face|page))[A-Za-z\-]++""" + _JVM_PRELUDE + r""";?"""
    r"""|@[A-Za-z\-]++|[{}]|[^/"'u@{}]++|."""
)


def with_sheet_pieces(sheets: DataFrame, content: str, nested: bool, name: str = "pieces") -> DataFrame:
    """``sheets`` with ``name``: ``split_sheet`` of ``content``, in the JVM.

    Each distinct sheet becomes token rows (a lossless regex split); the depth of
    braces is a running sum over them; an opening brace and its closing one
    are neighbours among the steps of one level; a statement at-rule followed
    by a brace (unless ``nested``) takes the tokens up to the matching close,
    or to the end, into its piece, and outermost such spans win.  Pieces fold
    back in order; a quoted string splits into its ``url(...)`` pieces.
    """
    rid = "__sheet_key"
    # pieces depend on the text alone: copies of a sheet are cut once
    key = F.sha2(F.col(content), 256)
    keyed = sheets.withColumn(rid, key)
    texts = sheets.where(F.col(content).isNotNull()).select(key.alias(rid), F.col(content)).dropDuplicates([rid])
    tokens = texts.select(rid, F.posexplode(F.regexp_extract_all(F.col(content), F.lit(JVM_SHEET_TOKEN), 0)).alias("pos", "tok"))
    by_pos = Window.partitionBy(rid).orderBy("pos")
    step = F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)
    tokens = tokens.withColumn("depth", F.sum(step).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    if nested:
        segments = tokens.withColumn("seg", F.col("pos"))
    else:
        # steps of one level alternate: an opening brace's next step there closes it
        steps = tokens.where(F.col("tok").isin("{", "}")).withColumn(
            "level", F.when(F.col("tok") == "{", F.col("depth")).otherwise(F.col("depth") + 1)
        )
        closes = steps.withColumn("match", F.lead("pos").over(Window.partitionBy(rid, "level").orderBy("pos"))).where(
            F.col("tok") == "{"
        ).select(rid, (F.col("pos") - 1).alias("pos"), "match")
        statement = F.col("tok").rlike(r"^@(?!(?i:font-face|page))[A-Za-z\-]") & ~F.col("tok").endswith(";")
        opens = (
            tokens.withColumn("next", F.lead("tok").over(by_pos))
            .join(closes, [rid, "pos"], "left")
            .withColumn("end", F.when(statement & (F.col("next") == "{"), F.coalesce("match", F.lit(2**62))))
        )
        before = F.max("end").over(by_pos.rowsBetween(Window.unboundedPreceding, -1))
        outer = F.col("end").isNotNull() & (before.isNull() | (before < F.col("pos")))
        spans = opens.withColumn("span", F.when(outer, F.struct(F.col("pos").alias("s"), F.col("end").alias("e"))))
        last = F.last("span", ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
        segments = spans.withColumn("span", last).withColumn(
            "seg", F.when(F.col("span.e") >= F.col("pos"), F.col("span.s")).otherwise(F.col("pos"))
        )
    ordered = F.sort_array(F.collect_list(F.struct("pos", "tok")))
    pieces = segments.groupBy(rid, "seg").agg(F.array_join(ordered.getField("tok"), "").alias("piece"), F.count(F.lit(1)).alias("n"))
    folded = pieces.groupBy(rid).agg(F.sort_array(F.collect_list(F.struct("seg", "piece", "n"))).alias("all")).select(
        rid, F.flatten(F.transform("all", lambda x: _one(x))).alias(name)
    )
    joined = keyed.join(folded, rid, "left")
    value = F.when(F.col(content).isNull(), F.lit(None)).otherwise(F.coalesce(F.col(name), F.array().cast("array<string>")))
    return joined.withColumn(name, value).drop(rid)


def _one(x: Column) -> Column:
    string = (x["n"] == 1) & x["piece"].rlike("^[\"'].")
    return F.when(string, F.regexp_extract_all(x["piece"], F.lit(URL_PIECES), 0)).otherwise(F.array(x["piece"]))


def is_ref_sql(piece: str) -> str:
    return f"(startswith({piece}, 'url(') and endswith({piece}, ')'))"


def ref_parts_sql(piece: str, entities: bool = False) -> str:
    """``struct<lead, ref, trail>`` of a reference token.  ``entities``: the
    text is an undecoded attribute value, whose quotes may be written out."""
    opening = r"^(?:['\"]|&quot;|&apos;|&#0*3[49];|&#[xX]0*2[27];)" if entities else r"^['\"]"
    closing = r"(?:['\"]|&quot;|&apos;|&#0*3[49];|&#[xX]0*2[27];)\z" if entities else r"['\"]\z"
    blanks = q(_BLANKS)

    def quotes(v: str) -> str:
        return let_struct(
            split,
            piece=f"{v}.piece",
            body=f"{v}.body",
            open=f"concat(substring({v}.body, 1, length({v}.body) - length({v}.left)), "
            f"regexp_extract({v}.left, {q(opening)}, 0))",
        )

    def split(v: str) -> str:
        inner = f"rtrim({blanks}, substring({v}.body, length({v}.open) + 1))"
        ref = f"regexp_replace({inner}, {q(closing)}, '')"
        return let_struct(
            lambda w: struct(
                lead=f"concat('url(', {w}.open)",
                ref=f"{w}.ref",
                trail=f"concat(substring({w}.body, length({w}.open) + length({w}.ref) + 1), ')')",
            ),
            body=f"{v}.body",
            open=f"{v}.open",
            ref=ref,
        )

    def left(v: str) -> str:
        return let_struct(quotes, piece=f"{v}.piece", body=f"{v}.body", left=f"ltrim({blanks}, {v}.body)")

    return let_struct(left, piece=piece, body=f"substring({piece}, 5, length({piece}) - 5)")


def refs_sql(text: str) -> str:
    """Non-empty one-line references of style text, in order."""
    return piece_refs_sql(f"regexp_extract_all({text}, {q(URL_TOKEN)}, 0)")


def piece_refs_sql(pieces: str) -> str:
    """The same of an array of pieces."""
    tokens = f"filter({pieces}, u -> {is_ref_sql('u')})"
    found = f"transform({tokens}, u -> {ref_parts_sql('u')}.ref)"
    return f"filter({found}, r -> r <> '' and not contains(r, {q(chr(10))}))"
