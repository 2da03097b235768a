"""Secret scans: fixed patterns, and a battery of randomness tests over other long tokens.

Only DataFrame expressions are used. Each text is cut at a pattern's matches; the lengths of the
pieces and matches add up to positions in code points. Tokens that no pattern covers but that
read like keys are tested under their inferred encoding: chi-squared uniformity of the alphabet,
runs about its middle, serial correlation. Fisher's method joins the three p-values, which are
uniform for random keys and near zero for prose. A threshold for each length class and encoding
holds the share of false discoveries: the count above one half tells how many random tokens to
expect below it, so what exceeds them among the flagged, and one more, counts as false. Time
and memory are linear in a text and its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: (kind, pattern, group that is the secret, its least length), in order of kind.
#: The first one's letters stand in either case, by Unicode: that includes the long s, the kelvin sign, the dotted I and the dotless i.
KINDS = (
    ("assign", r"""(?iu:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: What finds the same long matches of the last two kinds, and what must be there for any match of a kind.
_FIND = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: Tokens: an equals sign may stand before one or pad its end.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Parts, by either alphabet with signs, of a token that mixes both, such as a path with a base64url segment.
PARTS = (r"[A-Za-z0-9_-]{20,}={0,2}", r"[A-Za-z0-9+/]{20,}={0,2}")
#: Encodings by the characters a token may hold, with the alphabet in order; the first that fits counts.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_TOKEN_SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,token:string>>"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, start: str, step: str) -> str:
    """SQL of the running values of an array<bigint>: of the elements up to each, by step over ``total`` and ``x``.

    Arrays are appended to and sliced by copying, so it goes by runs of the square root of n elements.
    """
    none = "CAST(array() AS array<bigint>)"
    return f"""
      transform(array(transform(array({values}), v -> named_struct('all', v, 'run', CAST(ceil(sqrt(size(v) + 1)) AS int)))[0]), whole -> flatten(aggregate(
        sequence(0, CAST((size(whole.all) - 1) DIV whole.run AS int)),
        named_struct('total', {start}, 'runs', CAST(array() AS array<array<bigint>>)),
        (acc, k) -> transform(array(aggregate(
            slice(whole.all, k * whole.run + 1, whole.run),
            named_struct('total', acc.total, 'run', {none}),
            (a, x) -> transform(array({step.replace("total", "a.total")}), v -> named_struct('total', v, 'run', array_append(a.run, v)))[0])),
          r -> named_struct('total', r.total, 'runs', array_append(acc.runs, r.run)))[0],
        acc -> acc.runs)))[0]"""


def _found(text: str, pattern: str, group: int, least: int, kind: str, kind_no: int) -> str:
    """SQL of the matches of pattern in text whose group, which ends the match, has least characters: spans with their token.

    A match's end is the running length of what is before it; the time is linear in the text.
    """
    p = _literal(pattern)
    part = f"regexp_extract_all({text}, {p}, {group})" if group else "CAST(NULL AS array<string>)"
    return f"""
      CASE WHEN {text} RLIKE {p} THEN
        transform(array(named_struct('gap', split({text}, {p}, -1), 'whole', regexp_extract_all({text}, {p}, 0), 'part', {part})), m ->
          transform(array({_running("transform(m.whole, (w, i) -> CAST(length(m.gap[i]) + length(w) AS bigint))", "0L", "total + x")}), e ->
            filter(transform({"m.part" if group else "m.whole"}, (w, i) -> named_struct('start', e[i] - length(w), 'kind_no', {kind_no}, 'end', e[i], 'kind', '{kind}', 'token', w)),
              s -> s.end - s.start >= {least}))[0])[0]
      ELSE CAST(array() AS {_TOKEN_SPAN}) END"""


def match_spans(text: str, pattern: str, group: int, least: int, kind: str, kind_no: int) -> Column:
    """Spans of the matches of pattern in column text whose group, which ends the match, has least characters."""
    return F.expr(f"transform({_found(text, pattern, group, least, kind, kind_no)}, s -> named_struct('start', s.start, 'kind_no', s.kind_no, 'end', s.end, 'kind', s.kind))")


def _tokens(text: str) -> str:
    """SQL of the tokens of text outside the assign matches that the battery tests, each with its span."""
    p, no = _literal(KINDS[0][1]), len(KINDS)
    shifted = "named_struct('start', {0}.start + {1}, 'kind_no', {0}.kind_no, 'end', {0}.end + {1}, 'kind', {0}.kind, 'token', {0}.token)"
    parts = ", ".join(f"transform({_found('y.token', rx, 0, 20, 'random', no)}, z -> {shifted.format('z', 'y.start')})" for rx in PARTS)
    return f"""
      transform(array(named_struct('outside', split({text}, {p}, -1), 'inside', regexp_extract_all({text}, {p}, 0))), cut ->
        transform(array({_running("transform(cut.outside, (g, i) -> CAST(length(g) + coalesce(length(get(cut.inside, i)), 0) AS bigint))", "0L", "total + x")}), until ->
          filter(
            flatten(transform(flatten(transform(cut.outside, (piece, j) ->
                transform({_found("piece", TOKEN, 0, 20, "random", no)}, u -> {shifted.format("u", "coalesce(get(until, j - 1), 0L)")}))),
              y -> CASE WHEN y.token RLIKE '[+/]' AND y.token RLIKE '[_-]' THEN array_sort(concat({parts})) ELSE array(y) END)),
            y -> y.token RLIKE '[0-9]' AND y.token RLIKE '[A-Za-z]' AND NOT y.token RLIKE '{_FIND["access"]}|{_FIND["hex"]}'))[0])[0]"""


def _upper_tail(z: str) -> str:
    """1 - Phi(z), by a logistic curve that is right to 1.5e-4."""
    return f"(1 / (1 + exp(least(600D, 1.5976D * ({z}) + 0.07056D * pow({z}, 3)))))"


def randomness_p(token: str) -> str:
    """SQL of struct(encoding, p) for a token expression: p is the battery's joint p-value, null where no encoding fits."""
    encoding = "CASE " + " ".join(f"WHEN {token} RLIKE '{rx}' THEN named_struct('name', '{n}', 'alphabet', {_literal(a)})" for n, rx, a in ENCODINGS) + " END"
    return f"""
      transform(array({encoding}), e -> CASE WHEN e IS NULL THEN NULL ELSE
        transform(array(split(rtrim('=', {token}), '')), c ->
          transform(array(named_struct('n', CAST(size(c) AS double), 'a', CAST(length(e.alphabet) AS double),
              'v', transform(c, x -> CAST(instr(e.alphabet, x) - 1 AS double)),
              'squares', aggregate(array_distinct(c), 0D, (s, x) -> s + pow(size(filter(c, y -> y = x)), 2)))), t ->
            transform(array(named_struct('t', t,
                'chi', t.a / t.n * t.squares - t.n,
                'ones', CAST(size(filter(t.v, x -> x >= t.a / 2)) AS double),
                'runs', 1D + size(filter(sequence(1, size(t.v) - 1), i -> (t.v[i] >= t.a / 2) <> (t.v[i - 1] >= t.a / 2))),
                'mean', aggregate(t.v, 0D, (s, x) -> s + x) / t.n)), u ->
              transform(array(named_struct('t', t,
                  'z1', (u.chi - (t.a - 1)) / sqrt(2 * (t.a - 1) * (t.n - 1) / t.n),
                  'e', 2 * u.ones * (t.n - u.ones) / t.n + 1,
                  'runs', u.runs,
                  'r', coalesce(try_divide(
                        aggregate(sequence(1, size(t.v) - 1), 0D, (s, i) -> s + (t.v[i] - u.mean) * (t.v[i - 1] - u.mean)),
                        aggregate(t.v, 0D, (s, x) -> s + pow(x - u.mean, 2))), 1D))), w ->
                transform(array(named_struct(
                    'p1', {_upper_tail("w.z1")},
                    'p2', CASE WHEN w.e <= 2 THEN 0D ELSE 2 * {_upper_tail("abs(w.runs - w.e) / sqrt((w.e - 1) * (w.e - 2) / (t.n - 1))")} END,
                    'p3', 2 * {_upper_tail("abs(w.r + 1 / t.n) * sqrt(t.n)")})), p ->
                  transform(array(-ln(greatest(p.p1, 1e-12D)) - ln(greatest(p.p2, 1e-12D)) - ln(greatest(p.p3, 1e-12D))), h ->
                    named_struct('encoding', e.name, 'p', exp(-h) * (1 + h + h * h / 2)))[0]
                )[0])[0])[0])[0])[0] END)[0]"""


def scan_secrets(docs: DataFrame, max_false: float = 0.05, with_row: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, found (base spans), added (the battery's spans), and with_row all of docs as the struct row.

    Spans are structs of start, kind_no, end, kind, in code points with the end exclusive, sorted
    by start and kind. Base spans are the matches of KINDS, leftmost and non-overlapping per kind.
    Added ones are tokens of 20 characters or more with a digit and a letter, outside assign matches
    and without an access or hex match, whose p-value passes their length class and encoding's threshold at max_false expected
    false discoveries (see thresholds). Of a token that mixes + or /
    with - or _, its parts by either alphabet are tested instead, and such spans may overlap. Null and empty texts have
    none. Repeated rows give repeated rows, and an empty table gives none. The text is scanned
    once for thresholds (encodings times length classes, all that reaches the driver) and once for
    the result; nothing but the histogram is shuffled.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole_text"), *row)
    spans = [match_spans("whole_text", _FIND.get(kind, pattern), group, least, kind, k) for k, (kind, pattern, group, least) in enumerate(KINDS)]
    tested = F.expr(
        f"transform({_tokens('whole_text')}, x -> named_struct('span', named_struct('start', x.start, 'kind_no', x.kind_no, 'end', x.end, 'kind', x.kind),"
        f" 'class', CAST(floor(log2(length(x.token))) AS int), 'test', {randomness_p('x.token')}))"
    )
    classes = d.select(F.explode(tested).alias("x")).select("x.class", "x.test.encoding", "x.test.p")
    limits = thresholds(classes, max_false)
    passes = " OR ".join(f"(x.class = {k} AND x.test.encoding = '{e}' AND x.test.p >= {p}D)" for k, e, p in limits) or "false"
    found = d.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"), tested.alias("tested"), *["row"] * with_row)
    added = F.expr(f"transform(filter(tested, x -> {passes}), x -> x.span)")
    return found.select("doc_id", "found", added.alias("added"), *["row"] * with_row)


def thresholds(tests: DataFrame, max_false: float, bins: int = 100) -> list[tuple[int, str, float]]:
    """(class, encoding, least p to flag) from tests(class, encoding, p), by a histogram of p per class.

    A class with too few p-values of one half or more to allow max_false (under 1 / max_false)
    has no threshold of its own: such classes are one pool, with one threshold if the pool has enough.
    """
    h = tests.where("p IS NOT NULL").groupBy("class", "encoding", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("bin")).count()
    by: dict = {}
    for r in h.collect():  # at most classes x encodings x bins
        by.setdefault((r["class"], r.encoding), [0] * bins)[r.bin] += r["count"]
    few = [k for k, counts in by.items() if sum(counts[bins // 2 :]) * max_false < 1]
    pool = [sum(by[k][b] for k in few) for b in range(bins)]
    out = []
    for k, counts in sorted(by.items()):
        best = least_p(pool if k in few else counts, max_false)
        if best is not None:
            out.append((*k, best))
    return out


def least_p(counts: list[int], max_false: float) -> float | None:
    """The least p to flag from a histogram of p on [0, 1], null if nothing may be flagged.

    From one half on all are taken for random. Below, random tokens go on at that rate; what bins
    have beyond it, and one more, counts as false, and a bin with fewer earns no credit past zero.
    The walk down from one half stops where the share of false ones would exceed max_false.
    """
    bins = len(counts)
    upper = sum(counts[bins // 2 :])
    if upper * max_false < 1:
        return None
    flagged, best, beyond = upper, bins // 2, 0.0
    for b in range(bins // 2 - 1, -1, -1):
        flagged += counts[b]
        beyond = max(0.0, beyond + counts[b] - upper / (bins - bins // 2))
        if 1 + beyond > max_false * flagged:
            break
        best = b
    return best / bins


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of the pieces that a text is cut into, so that a span is found without reading from the start.
_PIECE = 1024


def redact(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The column text with every maximal run of overlapping spans (a column) replaced by mark; null stays null.

    Linear in the text and the number of spans.
    """
    between = f"""substring(array_join(slice(t.pieces, CAST(t.open[i] DIV {_PIECE} + 1 AS int), CAST(start DIV {_PIECE} - t.open[i] DIV {_PIECE} + 1 AS int)), ''),
      CAST(t.open[i] % {_PIECE} + 1 AS int), CAST(start - t.open[i] AS int))"""
    return F.expr(f"""
      CASE WHEN {text} IS NULL OR size({spans}) = 0 THEN {text} ELSE
        transform(array(array_sort({spans})), s ->
          transform(array({_running("transform(s, q -> q.end)", "0L", "greatest(total, x)")}), reach ->
            transform(array(filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i].start >= reach[greatest(i - 1, 0)])), first ->
              transform(array(named_struct(
                  'pieces', regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0),
                  'starts', concat(transform(first, i -> s[i].start), array(CAST(length({text}) AS bigint))),
                  'open', concat(array(0L), transform(first, (i, k) -> reach[coalesce(get(first, k + 1), size(s)) - 1])))), t ->
                array_join(transform(t.starts, (start, i) -> {between}), {_literal(mark)}))[0])[0])[0])[0] END""")
