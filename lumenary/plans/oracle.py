"""The same results in DuckDB's SQL, written on their own terms: the yardstick for the queries."""

from __future__ import annotations

from lumenary import rules as R

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_in(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def ends(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {text(w)})" for w in words) + ")"


def one_of(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(map(text, words))})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def missing(x: str) -> str:
    return f"coalesce({x}, '') IN ('', 'unknown')"


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = f"replace({x}, {text(a)}, {text(b)})"
    return f"regexp_replace({strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"


def boilerplate(x: str) -> str:
    return f"(regexp_matches({x}, {text('(?i)' + '|'.join(R.BOILERPLATE))}) OR length({strip(x)}) < {R.BOILERPLATE_MIN_CHARS})"


def noise(x: str) -> str:
    return f"({any_in(f'lower({x})', R.NOISE_PHRASES)} OR length({x}) < {R.NOISE_MIN_CHARS})"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){WS}+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda q: {strip('q')}), lambda q: q <> '')"


def distinct_sections(x: str) -> str:
    near = f"k.n = c[1].n OR ((contains(k.n, c[1].n) OR contains(c[1].n, k.n)) AND abs(length(k.n) - length(c[1].n)) < {R.NEAR_DUPLICATE_CHARS})"
    pairs = f"list_transform({x}, lambda s: [{{'n': {strip('lower(s)')}, 's': s}}])"
    return f"list_transform(CASE WHEN len({x}) = 0 THEN [] ELSE list_reduce({pairs}, lambda a, c: CASE WHEN len(list_filter(a, lambda k: {near})) > 0 THEN a ELSE list_concat(a, c) END) END, lambda k: k.s)"


def cleaned(lines: str) -> str:
    kept = f"list_filter(list_transform({lines}, lambda s: {clean('s')}), lambda s: s <> '' AND NOT {boilerplate('s')})"
    return distinct_sections(f"list_transform({kept}, lambda s: {strip('s')})")


def merge_short(x: str) -> str:
    step = f"CASE WHEN length(a.buf) < {R.MIN_CHUNK} THEN {{'done': a.done, 'buf': a.buf || ' ' || c.buf}} ELSE {{'done': list_append(a.done, a.buf), 'buf': c.buf}} END"
    first = f"list_transform({x}, lambda s: {{'done': CAST([] AS VARCHAR[]), 'buf': s}})"
    folded = f"list_reduce({first}, lambda a, c: {step})"
    return f"CASE WHEN len({x}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_append(({folded}).done, ({folded}).buf) END"


def _packed(parts: str) -> str:
    """Sentences into pieces of MAX_CHUNK; the first comes after an empty buffer, so a blank stands before it."""
    step = (f"CASE WHEN length(a.buf) + length(c.buf) + 1 > {R.MAX_CHUNK} AND a.buf <> '' THEN {{'done': list_append(a.done, {strip('a.buf')}), 'buf': c.buf}} "
            "ELSE {'done': a.done, 'buf': a.buf || ' ' || c.buf} END")
    first = f"list_transform(list_prepend('', {parts}), lambda s: {{'done': CAST([] AS VARCHAR[]), 'buf': s}})"
    folded = f"list_reduce({first}, lambda a, c: {step})"
    return f"list_filter(list_append(({folded}).done, {strip(f'({folded}).buf')}), lambda z: z <> '')"


def split_long(x: str) -> str:
    return f"flatten(list_transform({x}, lambda w: CASE WHEN length(w) <= {R.MAX_CHUNK} THEN [w] ELSE {_packed(sentences('w'))} END))"


def groups(x: str) -> str:
    n = R.SENTENCES_PER_GROUP
    return (f"flatten(list_transform({x}, lambda v: list_transform(range(0, len({sentences('v')}), {n}), "
            f"lambda i: array_to_string(list_slice({sentences('v')}, i + 1, i + {n}), ' '))))")


def transcript(x: str) -> str:
    step = (f"CASE WHEN length(a.buf) + 1 + length(c.buf) > {R.TRANSCRIPT_BLOCK} THEN {{'done': list_append(a.done, {strip("a.buf || ' ' || c.buf")}), 'buf': ''}} "
            "ELSE {'done': a.done, 'buf': a.buf || ' ' || c.buf} END")
    kept = f"list_filter({x}, lambda s: {strip('s')} <> '')"
    first = f"list_transform(list_prepend('', {kept}), lambda s: {{'done': CAST([] AS VARCHAR[]), 'buf': s}})"
    folded = f"list_reduce({first}, lambda a, c: {step})"
    return f"list_filter(list_append(({folded}).done, {strip(f'({folded}).buf')}), lambda z: z <> '')"


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def kind(url: str) -> str:
    return f"CASE WHEN regexp_matches(lower({url}), {text(R.VIDEO_URL)}) THEN 'youtube' WHEN regexp_matches(lower({url}), {text(R.ARTICLE_URL)}) THEN 'pubmed' ELSE 'blog' END"


def region(url: str) -> str:
    h = host(url)
    suffixes = " ".join(f"WHEN ends_with({h}, {text(s)}) THEN {text(R.SUFFIX_REGIONS[s])}" for s in sorted(R.SUFFIX_REGIONS, key=lambda s: -len(s)))
    return f"CASE WHEN {any_in(h, R.US_HOSTS)} THEN 'US' WHEN {any_in(h, R.GLOBAL_HOSTS)} THEN 'global' {suffixes} ELSE 'unknown' END"


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def domain(url: str, kind_: str) -> str:
    h, out = host(url), [f"WHEN coalesce({url}, '') = '' THEN {number(R.DOMAIN_NO_URL)}"]
    for score, names in R.DOMAIN_TIERS:
        out.append(f"WHEN {any_in(h, names)} THEN {number(score)}")
        if score == 1.0:
            out.append(f"WHEN {ends(h, R.TOP_SUFFIXES)} THEN {number(score)}")
    out += [f"WHEN {kind_} = '{k}' THEN {number(v)}" for k, v in R.DOMAIN_DEFAULTS.items()]
    return f"CASE {' '.join(out)} ELSE {number(R.DOMAIN_OTHER)} END"


def steps(pairs: list[tuple[str, float]], other: float) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {number(v)}" for c, v in pairs) + f" ELSE {number(other)} END"


def author(name: str, names: str, kind_: str) -> str:
    low, institutional = f"lower({name})", any_in(f"lower({name})", R.INSTITUTIONAL)
    absent = steps([(f"{kind_} = 'pubmed'", 0.3), (f"{kind_} = 'youtube'", 0.2)], 0.15)
    paper = steps([(f"len({names}) >= 3", 0.95), (f"len({names}) = 2", 0.9), (institutional, 0.9)], 0.8)
    video = steps([(any_in(strip(low), R.TRUSTED_CHANNELS), 0.85), (institutional, 0.8), (f"regexp_matches({name}, '^[A-Z]') AND length({name}) > 4", 0.6)], 0.5)
    page = steps([(institutional, 0.85), (any_in(low, R.CORPORATE), 0.8), (f"regexp_matches({name}, '^[A-Z][a-z]+ [A-Z][a-z]+')", 0.7),
                  (f"regexp_matches({name}, '^[A-Z][a-z]{{2,}}')", 0.55)], 0.45)
    return (f"CASE WHEN {missing(name)} THEN {absent} WHEN {one_of(strip(low), R.WEAK_AUTHORS)} OR length({strip(low)}) < 3 THEN {number(0.2)} "
            f"WHEN {kind_} = 'pubmed' THEN {paper} WHEN {kind_} = 'youtube' THEN {video} WHEN {kind_} = 'blog' THEN {page} ELSE {number(0.5)} END")


def two(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


def content(sections: str, about: str, title: str, kind_: str) -> str:
    joined = f"array_to_string({sections}, ' ')"
    k = "(" + " + ".join(f"CAST(contains(lower({joined}), {text(w)}) AS INT)" for w in R.ABSTRACT_KEYWORDS) + ")"
    paper = steps([(f"{k} >= 3", 0.95), (f"{k} >= 1", 0.85), (f"length({joined}) > 100", 0.7)], 0.5)
    plain = strip(f"regexp_replace({about}, 'https?://[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', '', 'g')")
    video = f"least({number(1.0)}, {number(0.5)} + {steps([(f'length({joined}) > 500', 0.3), (f'length({joined}) > 100', 0.15)], 0.0)} + {steps([(f'length({plain}) > 200', 0.2)], 0.0)})"
    words = f"len(list_filter(regexp_split_to_array({joined}, '{WS}+'), lambda w: w <> ''))"
    page = (f"{number(0.3)} + {steps([(f'{words} >= 1500', 0.35), (f'{words} >= 800', 0.25), (f'{words} >= 300', 0.15)], 0.0)} "
            f"+ {steps([(f'len({sections}) >= 8', 0.2), (f'len({sections}) >= 4', 0.1)], 0.0)} + {steps([(f'length({about}) > 50', 0.1)], 0.0)} "
            f"+ {steps([(f'NOT {missing(title)}', 0.05)], 0.0)}")
    return f"CASE WHEN {kind_} = 'pubmed' THEN {paper} WHEN {kind_} = 'youtube' THEN {video} ELSE least({number(1.0)}, {two(page)}) END"


def recency(raw: str, day: str, kind_: str, as_of: str) -> str:
    age = f"(date_diff('day', {day}, DATE '{as_of}') / {number(365.25)})"

    def of(name: str) -> str:
        limits, beyond, gone = R.RECENCY[name]
        return steps([(missing(raw), gone), (f"{day} IS NULL", R.RECENCY_UNPARSED), *[(f"{age} <= {years}", v) for years, v in limits]], beyond)

    return f"CASE WHEN {kind_} = 'pubmed' THEN {of('pubmed')} WHEN {kind_} = 'youtube' THEN {of('youtube')} ELSE {of('blog')} END"


def disclaimer(tags: str, sections: str, about: str, kind_: str) -> str:
    medical = f"list_has_any({tags}, [{', '.join(map(text, R.MEDICAL_TAGS))}])"
    low = f"lower(array_to_string({sections}, ' ') || ' ' || {about})"
    return (f"CASE WHEN {kind_} = 'pubmed' THEN {steps([(medical, 0.85)], 0.7)} WHEN NOT {medical} THEN {number(0.5)} WHEN {any_in(low, R.DISCLAIMERS)} THEN {number(1.0)} "
            f"WHEN {kind_} = 'youtube' THEN {number(0.15)} ELSE {number(0.1)} END")


def trust(kind_: str, a: str, q: str, d: str, r: str, m: str) -> str:
    def total(name: str) -> str:
        return " + ".join(f"{number(w)} * {x}" for w, x in zip(R.WEIGHTS[name], (a, q, d, r, m), strict=True))

    return f"greatest({number(0.0)}, least({number(1.0)}, {two(f"(CASE WHEN {kind_} = 'youtube' THEN {total('youtube')} WHEN {kind_} = 'pubmed' THEN {total('pubmed')} ELSE {total('blog')} END)")}))"


def tags(low: str, topics: list[tuple[str, str]] | None = None) -> str:
    each = [f"CASE WHEN {any_in(low, [t.lower(), *about.lower().split(', ')])} THEN {text(t)} END" for t, about in topics or R.TOPICS]
    return f"list_filter([{', '.join(each)}], lambda t: t IS NOT NULL)"


def chunks(sections: str, kind_: str) -> str:
    """As a subquery expression over ``sections``: each step named, so it is written once."""
    parts = f"CASE WHEN {kind_} = 'pubmed' THEN {groups(sections)} ELSE list_filter({sections}, lambda s: {strip('s')} <> '') END"
    return (f"(SELECT list_filter(list_transform({split_long('m.merged')}, lambda s: {strip('s')}), lambda s: s <> '') "
            f"FROM (SELECT {merge_short('p.parts')} AS merged FROM (SELECT {parts} AS parts) p) m)")


def language(rows: str, key: str, x: str, gains: list[tuple[str, str, float]]) -> str:
    """key and language of the texts ``x`` of ``rows``: by script, or else by frequent words."""
    letters = f"length(regexp_replace({x}, '[^\\p{{L}}]+', '', 'g'))"
    written = {lang: f"length(regexp_replace({x}, '[^{chars}]+', '', 'g'))" for lang, chars in R.LANGUAGE_SCRIPTS.items()}
    ja, zh = written["ja"], written["zh-cn"]
    mixed = f"({ja} * 10 >= {zh})"
    written |= {"ja": f"CASE WHEN {mixed} AND {ja} > 0 THEN {ja} + {zh} ELSE {ja} END", "zh-cn": f"CASE WHEN {mixed} AND {ja} > 0 THEN 0 ELSE {zh} END"}
    script = " ".join(f"WHEN 2 * ({n}) > {letters} THEN {text(lang)}" for lang, n in written.items())
    table = ", ".join(f"({text(w)}, {text(lang)}, {number(g)})" for w, lang, g in gains)
    return f"""(WITH kw(w, lang, gain) AS (VALUES {table}),
  src AS (SELECT {key}, {x} AS x, CASE WHEN length({x}) < {R.LANGUAGE_MIN_CHARS} THEN 'unknown' {script} END AS told FROM {rows}),
  best AS (SELECT {key}, lang FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, lang DESC) AS r FROM (
    SELECT {key}, lang, round(sum(gain), 6) AS gain FROM (SELECT {key}, unnest(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')) AS w FROM src) JOIN kw USING (w) GROUP BY ALL)) WHERE r = 1)
  SELECT {key}, coalesce(told, lang, 'unknown') AS language FROM src LEFT JOIN best USING ({key}))"""


def plain_words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}]+', ' ', 'g'))"


def _runs(rows: str, keys: str, x: str) -> str:
    """keys, n, run and m, how often: the runs of one to three letters of each word of the texts ``x`` of ``rows``; words begin and end with a blank, which is no run alone."""
    return (f"(SELECT {keys}, n, run, sum(m) AS m FROM (SELECT {keys}, m, n, substr(t, unnest(range(1, length(t) - n + 2)), n) AS run FROM "
            f"(SELECT {keys}, ' ' || w || ' ' AS t, count(*) AS m FROM (SELECT {keys}, unnest(string_split({plain_words(x)}, ' ')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL), (VALUES (1), (2), (3)) v(n)) "
            "WHERE run <> ' ' GROUP BY ALL)")


def language_by_profiles(rows: str, key: str, x: str, least: float, odds: float) -> str:
    """key and language of the texts ``x`` of ``rows``, by runs of letters in the labelled documents."""
    return f"""(WITH lk AS {_runs('documents', 'lang', 'text')},
  lp AS (SELECT lang AS told, run, ln(1 + m / total * {odds!r}) AS gain FROM (SELECT *, sum(m) OVER (PARTITION BY lang, n) AS total FROM lk WHERE lang IS NOT NULL) WHERE m / total >= {least!r}),
  xt AS (SELECT {key}, {x} AS x FROM {rows} WHERE length({x}) >= {R.LANGUAGE_MIN_CHARS}),
  xk AS {_runs('xt', key, 'x')},
  xb AS (SELECT {key}, told FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, told DESC) AS r FROM (
    SELECT {key}, told, round(sum(m * gain), 6) AS gain FROM xk JOIN lp USING (run) GROUP BY ALL)) WHERE r = 1)
  SELECT {key}, coalesce(told, 'unknown') AS language FROM {rows} LEFT JOIN xb USING ({key}))"""
