"""SQL building blocks for the catalogue: the same mappings and bands, for DuckDB."""

from __future__ import annotations

from tierloom import config
from tierloom.functions import labels, text


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def among(words) -> str:
    return quoted(words).replace("[", "(").replace("]", ")")


def band(x: str, bands) -> str:
    whens = " ".join(f"WHEN {x} {'<=' if inside else '<'} {bound} THEN '{label}'" for label, bound, inside in bands[:-1])
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE '{bands[-1][0]}' END"


def bucket(level: str) -> str:
    return "CASE " + " ".join(f"WHEN {level} BETWEEN {min(v)} AND {max(v)} THEN '{k}'" for k, v in config.BUCKETS.items()) + " END"


def target(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in config.TARGETS.items()) + " END"


def mode(n: str, goal: str) -> str:
    return f"CASE WHEN {n} < {config.FLOOR_PER_BUCKET} THEN 'sem_analise' WHEN {n} >= {goal} THEN 'completo' ELSE 'reduzido' END"


def percent(part: str, whole: str) -> str:
    return f"CAST(coalesce(round_even({part} * 100 / CASE WHEN {whole} > 0 THEN {whole} END, 0), 0) AS INTEGER)"


def force(pct: str) -> str:
    return f"list_position({quoted(b[0] for b in labels.QUANTIFIER_BANDS)}, {band(pct, labels.QUANTIFIER_BANDS)}) - 1"


def declared_force(phrase: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({phrase}), '{k}') THEN {labels.PHRASE_FORCES[k]}" for k in sorted(labels.PHRASE_FORCES, key=len, reverse=True)) + " END"


def has_any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{m}')" for m in markers) + ")"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def bare_words(x: str) -> str:
    return rf"list_transform(string_split_regex({stripped(x)}, '\s+'), lambda w: lower(trim(w, '.,;:!?()\"''')))".replace('\\"', '"')


def count_among(words: str, known) -> str:
    return f"len(list_filter({words}, lambda w: w IN {among(known)}))"


def letters(x: str) -> str:
    return rf"regexp_extract_all({x}, '\p{{L}}+')"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({x}, '{text.SENTENCE}'), lambda s: {stripped('s')}), lambda s: s <> '')"


def masked_words(x: str) -> str:
    t = f"lower({x})"
    for phrase in sorted(text.MANDATORY_PHRASES, key=len, reverse=True):
        t = f"replace({t}, '{phrase}', ' § ')"
    return letters(f"regexp_replace({t}, '~?{text.NUMBER}', ' § ', 'g')")


def lower(x: str) -> str:
    return f"lower({x})"


def unquoted(x: str) -> str:
    """A text without quotation marks, its white space tidied where it had any."""
    marks_, bare = text.QUOTES.replace("'", "''"), chr(92)
    clean = stripped(f"regexp_replace(regexp_replace({x}, '{bare * 2}?[{marks_}]', '', 'g'), '[ {bare}t]{{2,}}', ' ', 'g')")
    return f"CASE WHEN regexp_matches({x}, '[{marks_}]') THEN {clean} ELSE {x} END"


def unescaped(x: str) -> str:
    for entity, mark in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        x = f"replace({x}, '&{entity};', '{mark}')"
    return x


def numbers(x: str) -> str:
    return f"list_sort(regexp_extract_all({x}, '{text.NUMBER}'))"


def wrapped(x: str) -> str:
    t = stripped(x)
    lines = f"list_filter(string_split_regex({t}, '\\r?\\n'), lambda y: {stripped('y')} <> '')[1:3]"
    count = lambda c: f"(length({t}) - length(replace({t}, '{c}', '')))"
    field = rf"""len(list_filter({lines}, lambda y: regexp_matches(y, '^\s*"?[A-Za-z_]\w*"?\s*:\s*\S'))) > 0"""
    return f"""({t} <> '' AND (left({t}, 1) IN ('{{', '[') OR contains({t}, '```') OR {field} OR {count("{")} <> {count("}")}))"""


def labels_up_to(x: str) -> str:
    names = quoted(b[0] for b in labels.WEIGHT_BANDS)
    return f"{names}[1:list_position({names}, {band(x, labels.WEIGHT_BANDS)})]"


def percent_place(x: str, pct: str) -> str:
    """Place of "N%" without a digit before it, 0 if nowhere."""
    whole = f"'^((?s:.*?)(?:^|[^0-9]))' || {pct} || '%'"
    return f"CASE WHEN regexp_matches({x}, {whole}) THEN length(regexp_extract({x}, {whole}, 1)) + 1 ELSE 0 END"


def anchored(x: str, pct: str) -> str:
    return f"(len(list_filter({labels_up_to(pct)}, lambda r: contains(lower({x}), r))) > 0 OR {percent_place(lower(x), pct)} > 0)"


def anchor_place(x: str, pct: str) -> str:
    return f"list_min(list_filter(list_append(list_transform({labels_up_to(pct)}, lambda r: instr(lower({x}), r)), {percent_place(lower(x), pct)}), lambda p: p > 0))"


def marks(x: str, pattern: str) -> str:
    """All matches in order as structs of place and token."""
    parts, tokens = f"string_split_regex({x}, '{pattern}')", f"regexp_extract_all({x}, '{pattern}')"
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda y: length(y))), 0)"
    return f"list_transform(range(1, len({tokens}) + 1), lambda k: struct_pack(place := (1 + {size(f'{parts}[1:k]')} + {size(f'{tokens}[1:k - 1]')})::BIGINT, token := {tokens}[k]))"


def sentence_bounds(x: str) -> str:
    """First and last place of every sentence that is more than white space, the last one behind it."""
    start = rf"m.place + length(m.token) - length(regexp_replace(m.token, '^\s+', ''))"
    told = f"list_transform({marks(x, text.SENTENCE)}, lambda m: struct_pack(a := {start}, t := {stripped('m.token')}))"
    return f"list_filter({told}, lambda b: b.t <> '')"


def sentence_at(bounds: str, place: str) -> str:
    held = f"list_filter(range(1, len({bounds}) + 1), lambda i: {bounds}[i].a <= {place} AND {place} <= {bounds}[i].a + length({bounds}[i].t))"
    return f"CASE WHEN {place} IS NOT NULL THEN list_min({held}) - 1 END"


def marker_verdict(x: str, shares: dict[str, str]) -> str:
    ways = "|".join(sorted(text.ATTRIBUTIONS, key=len, reverse=True))
    dominant, whens = f"greatest({', '.join(shares.values())})", []
    for bucket_name, share in shares.items():
        at, others = anchor_place(x, share), ", ".join(anchor_place(x, o) for o in shares.values() if o != share)
        end = f"coalesce(list_min(list_filter([{others}], lambda p: p > {at})), length({x}) + 1)"
        movement = f"substring(lower({x}), {at}, {end} - {at})"
        own, both = f"'^[^.!?]*([.!?]+({ways})?)?'", f"'^[^.!?]*([.!?]+[^.!?]*([.!?]+({ways})?)?)?'"
        early = f"CASE WHEN {at} > 1 AND substring({x}, {at} - 1, 1) IN ('.', '!', '?') THEN regexp_extract({movement}, {own}) ELSE regexp_extract({movement}, {both}) END"
        # no share asks for a mark that is more than a third of the greatest
        asks = f"{share} IS NOT NULL AND {dominant} > 0 AND {share} <= {dominant} / 3"
        whens += [
            f"WHEN {asks} AND {at} IS NULL THEN 'unanchored:{bucket_name}'", f"WHEN {asks} AND NOT {has_any(movement, text.ATTRIBUTIONS)} THEN 'unmarked:{bucket_name}'",
            f"WHEN {asks} AND {share} <= {dominant} / 10 AND NOT {has_any(early, text.ATTRIBUTIONS)} THEN 'late:{bucket_name}'",
        ]
    return "CASE " + " ".join(whens) + " ELSE 'ok' END"


def vocabulary_ok(x: str) -> str:
    from tierloom.functions import spans

    low = lower(x)
    after = f"list_transform({marks(low, '|'.join(text.PLAIN_WEIGHTS))}, lambda m: substring({low}, m.place + length(m.token), {spans.AFTER_LABEL}))"
    before = f"list_transform({marks(low, spans.PERCENT)}, lambda m: right(left({low}, m.place - 1), {spans.BEFORE_PERCENT}))"
    noun = "list_min(list_filter([" + ", ".join(f"instr(w, '{n}')" for n in text.WRONG_NOUNS) + "], lambda p: p > 0))"
    return f"len(list_filter(list_concat({after}, {before}), lambda w: {noun} IS NOT NULL AND (instr(w, 'notas') = 0 OR {noun} < instr(w, 'notas')))) = 0"


def labels_lowered(x: str) -> str:
    for label, _, _ in labels.WEIGHT_BANDS:
        x = rf"regexp_replace({x}, '([^.!?\s]\s*)\b{label[0].upper()}{label[1:]}\b', '\1{label}', 'g')"
    return x


def honesty(x: str, shares: dict[str, str]) -> str:
    """The checks of prose with shares that ``x`` fails."""
    n = {k: count_among(bare_words(x), v) for k, v in (("pt", text.STOPWORDS_PT), ("en", text.STOPWORDS_EN))}
    whens = {
        "idioma": f"{n['pt']} < {n['en']}", "escopo": has_any(x, text.SCOPE_MARKERS), "vocabulario_peso": f"NOT ({vocabulary_ok(x)})",
        "ancoragem_peso": "NOT (" + " AND ".join(anchored(x, s) for s in shares.values()) + ")", "perspectiva_nao_marcada": f"{marker_verdict(x, shares)} <> 'ok'",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in whens.items()) + "], lambda f: f IS NOT NULL)"


def other_case(x: str) -> str:
    head = f"left({x}, 1)"
    return rf"CASE WHEN NOT regexp_matches({head}, '\p{{L}}') THEN {x} WHEN {head} = upper({head}) THEN lower({head}) || substring({x}, 2) ELSE upper({head}) || substring({x}, 2) END"


def protected_in_order(x: str, shares) -> str:
    """The candidates for protected spans in the order in which they are tried."""
    phrase = lambda s: f"{band(s, labels.WEIGHT_BANDS)} || ' das notas (~' || {s} || '%)'"
    told = [f"list_concat([{phrase(s)}], list_transform({labels_up_to(s)}, lambda r: r || ' das notas (~' || {s} || '%)'))" for s in shares]
    tokens = f"list_transform(regexp_extract_all({x}, '~?{text.NUMBER}'), lambda r: {stripped('r')})"
    wanted = told[0]
    for one in (*told[1:], tokens):
        wanted = f"list_concat({wanted}, {one})"
    return wanted


def protected(x: str, shares) -> str:
    """Weight phrases and numbers as the text has them, each once."""
    told = [f"list_transform({labels_up_to(s)}, lambda r: r || ' das notas (~' || {s} || '%)')" for s in shares]
    tokens = f"list_transform(regexp_extract_all({x}, '~?{text.NUMBER}'), lambda r: {stripped('r')})"
    wanted = tokens
    for one in told:
        wanted = f"list_concat({wanted}, {one})"
    own = f"CASE WHEN contains({x}, c) THEN c WHEN instr(lower({x}), lower(c)) > 0 THEN substring({x}, instr(lower({x}), lower(c)), length(c)) END"
    return f"list_distinct(list_filter(list_transform({wanted}, lambda c: {own}), lambda c: c IS NOT NULL AND c <> ''))"


RATINGS = "ratings AS (SELECT l_suppkey AS film, ceil(l_quantity / 5) / 2 AS level FROM lineitem)"
HISTOGRAM = f"{RATINGS}, histogram AS (SELECT film, level, {bucket('level')} AS bucket, count(*) AS n FROM ratings GROUP BY ALL)"
DISTRIBUTION = f"""{HISTOGRAM},
dim(bucket) AS (VALUES {", ".join(f"('{b}')" for b in config.BUCKETS)}),
totals AS (SELECT film, sum(n)::BIGINT AS n_total FROM histogram WHERE bucket IS NOT NULL GROUP BY film HAVING sum(n) > 0),
distribution AS (
  SELECT film, bucket, coalesce(sum(n), 0)::BIGINT AS n_ratings, n_total, {percent("coalesce(sum(n), 0)", "n_total")} AS share_real
  FROM totals CROSS JOIN dim LEFT JOIN histogram USING (film, bucket) GROUP BY film, bucket, n_total)"""
REVIEWS = f"""placed AS (
  SELECT *, doc_id // 10 // {config.PAGE_ROWS} + 1 + CASE WHEN lang = 'de' AND doc_id // 10 >= {config.PAGE_ROWS} THEN 1 ELSE 0 END AS own
  FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id)),
reviews AS (
  SELECT lang AS film, (doc_id % 10 + 1) / 2 AS level, CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS review_id, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 10 + 1) / 2 END AS rating, text, doc_id,
    coalesce(toxic, 0) = 1 AS spoiler, doc_id % 7 = 0 AS truncated, CASE WHEN doc_id % 21 <> 0 THEN '/full/' || doc_id END AS full_text_url,
    (own + again)::INTEGER AS page, doc_id // 10 % {config.PAGE_ROWS} + again * {config.PAGE_ROWS} AS pos
  FROM placed JOIN (VALUES (0), (1)) t(again) ON again = 0 OR (lang = 'de' AND doc_id // 10 < {config.PAGE_ROWS}) OR doc_id % 5 = 0),
eligible AS (SELECT *, rating IS NOT NULL AND NOT spoiler AS ok FROM reviews)"""
PAGES = f"""{REVIEWS},
marked AS (
  SELECT *, review_id IS NULL OR row_number() OVER (PARTITION BY film, level, review_id ORDER BY page, pos) = 1 AS first
  FROM eligible WHERE page <= {config.MAX_PAGES}),
pages_seen AS (SELECT film, level, page, count(*) AS n_rows, count_if(first) AS n_first, count_if(first AND ok AND length(text) >= 150) AS n_valid FROM marked GROUP BY ALL),
pages_read AS (
  SELECT *, coalesce(sum(n_valid) OVER (PARTITION BY film, level ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {config.QUOTA_PER_LEVEL}
    AND row_number() OVER (PARTITION BY film, level ORDER BY page) = page AS kept
  FROM pages_seen)"""
CASCADE = f"""{PAGES},
rows_read AS (SELECT e.* FROM marked e JOIN pages_read p ON e.film = p.film AND e.level = p.level AND e.page = p.page AND kept WHERE first),
cascade AS (
  SELECT *, CASE WHEN bool_or(ok AND length(text) >= 150) OVER w THEN 150 WHEN bool_or(ok AND length(text) >= 50) OVER w THEN 50 ELSE 0 END AS threshold
  FROM rows_read WINDOW w AS (PARTITION BY film, level)),
quota AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY film, level ORDER BY page, pos) AS rank FROM cascade WHERE ok AND length(text) >= threshold)
  WHERE rank <= {config.QUOTA_PER_LEVEL})"""
COMPLETED = f"""{CASCADE},
completed AS (
  SELECT film, level, review_id, CASE WHEN NOT truncated THEN 'complete' WHEN full_text_url IS NULL THEN 'no_url' WHEN doc_id % 14 = 0 THEN 'fetch_failed'
    WHEN doc_id % 15 = 0 THEN 'spoiler_in_full' ELSE 'completed' END AS status FROM quota)"""
METADATA = f"""{COMPLETED},
late AS (
  SELECT film, level, count_if(status IN ('complete', 'completed')) AS n_valid, count_if(status NOT IN ('complete', 'completed')) AS n_truncation,
    count_if(status = 'spoiler_in_full') AS n_late FROM completed GROUP BY ALL),
metadata AS (
  SELECT film, level, max(threshold) AS threshold, count(DISTINCT page) AS n_pages, count(*) AS n_raw, count_if(rating IS NULL) AS n_unrated,
    count_if(rating IS NOT NULL AND spoiler) + coalesce(any_value(n_late), 0) AS n_spoiler, count_if(ok AND length(text) < threshold) AS n_short,
    coalesce(any_value(n_truncation), 0) AS n_truncation, coalesce(any_value(n_valid), 0) AS n_valid
  FROM cascade LEFT JOIN late USING (film, level) GROUP BY film, level)"""
BUCKETS = f"""{METADATA},
buckets AS (
  SELECT film, bucket, {target("bucket")} AS target, n_raw, n_valid, {mode("n_valid", target("bucket"))} AS mode
  FROM (SELECT film, {bucket("level")} AS bucket, sum(n_raw)::BIGINT AS n_raw, sum(n_valid)::BIGINT AS n_valid FROM metadata GROUP BY ALL))"""


def _assigned() -> str:
    from tierloom.sources.tables import THEMES

    ids = ", ".join(f"CASE WHEN {has_any('text', words)} THEN '{theme}' END" for theme, words in THEMES.items())
    places = " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(THEMES))
    return f"""assigned AS (
  SELECT lang AS film, {bucket("(doc_id % 10 + 1) / 2")} AS bucket, doc_id AS review_id,
    CASE WHEN text IS NOT NULL THEN list_filter([{ids}], lambda x: x IS NOT NULL) END AS theme_ids
  FROM documents),
mentions AS (SELECT film, bucket, theme_id, count(*) AS mentions FROM (SELECT film, bucket, unnest(theme_ids) AS theme_id FROM assigned) GROUP BY ALL),
sizes AS (SELECT film, bucket, count(*) AS n_reviews FROM assigned GROUP BY ALL),
themes AS (
  SELECT film, bucket, theme_id AS theme, CASE theme_id {places} END AS ord, mentions::INTEGER AS mentions, n_reviews, {percent("mentions", "n_reviews")} AS pct
  FROM mentions JOIN sizes USING (film, bucket))"""


THEMES = _assigned()
