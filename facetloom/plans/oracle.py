"""DuckDB statements for the shared views that oracle queries start from."""

from __future__ import annotations

from facetloom.functions import vocab as V


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def dedup(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def clean(c: str, limit: int | None = 180) -> str:
    stripped = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'), ' -;,.' || chr(9) || chr(10))"
    return stripped if limit is None else f"rtrim(substr({stripped}, 1, {limit}))"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def tags(c: str, vocabulary) -> str:
    return f"regexp_extract_all(lower({c}), '\\b({'|'.join(vocabulary)})\\b', 1)"


def classify(c: str, colors=V.CONVERSATION_COLORS) -> str:
    def has(values):
        return f"regexp_matches(lower({c}), '{'|'.join(values)}')"

    return (
        f"CASE WHEN regexp_matches(lower({c}), 'budget|(\\$|<=|under)\\s*\\d') THEN 'budget' "
        f"WHEN {has(V.MATERIALS)} THEN 'material' WHEN {has(('color', *colors))} THEN 'color' "
        f"WHEN {has(V.SIZE_WORDS)} THEN 'size' WHEN {has(V.STYLE_WORDS)} THEN 'style' "
        f"WHEN {has(V.USE_CASE_WORDS)} THEN 'use_case' ELSE 'feature' END"
    )


def stable_int(*parts: str) -> str:
    joined = " || chr(0) || ".join(parts)
    return f"('0x' || substr(sha256({joined}), 1, 16))::UBIGINT"


def hash_key(*parts: str) -> str:
    joined = " || chr(0) || ".join(parts)
    return f"substr(sha256({joined}), 1, 16)"


def coarse(names: str) -> str:
    pieces = (
        f"list_filter(list_transform(flatten(list_transform({names}, lambda x: string_split(x, ','))), "
        f"lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ({quoted(V.GENERIC_CATEGORIES)}))"
    )
    return (
        f"CASE WHEN len({pieces}) > 0 THEN array_to_string({pieces}[greatest(1, len({pieces}) - 1):], ' ') "
        f"ELSE '{V.DEFAULT_CATEGORY}' END"
    )


def hash_weight(*parts: str) -> str:
    return f"(({stable_int(*parts)} % 2001)::BIGINT - 1000) / 1000.0::DOUBLE"


def turn_bucket(c: str) -> str:
    return f"CASE WHEN {c} <= 3 THEN 'early' WHEN {c} <= 6 THEN 'middle' ELSE 'late' END"


def price_bucket(c: str) -> str:
    arms, lower = f"CASE WHEN {c} IS NULL THEN 'missing' ", 0
    for upper in V.PRICE_EDGES:
        arms += f"WHEN {c} < {upper} THEN '{lower}_{upper}' "
        lower = upper
    return arms + f"ELSE '{lower}_plus' END"


def rating_bucket(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'missing' ELSE format('{{:.1f}}', round_even({c} * 2, 0) / 2) END"


def popularity_bucket(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN 'missing' ELSE least(16, len(ltrim(bin(greatest(0, {c}) + 1), '0')) - 1)"
        "::VARCHAR END"
    )


MATERIAL_LIST = quoted(V.MATERIALS)
PID = "'P' || lpad({0}::VARCHAR, 8, '0')"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "prod": (
        (),
        f"""SELECT {PID.format('p_partkey')} AS parent_asin, p_name AS title, p_type, p_brand,
  CASE WHEN p_partkey % 10 < 9 THEN ['100% ' || ([{MATERIAL_LIST}])[p_partkey % 10 + 1], 'Size ' || p_size]
       ELSE ['Size ' || p_size] END AS features,
  ['Department: ' || p_type, 'Brand: ' || p_brand] AS detail_items,
  ['Parts', p_type, split_part(p_name, ' ', 2)] AS categories, p_brand AS store,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS price,
  floor(q * 10 / n) / 100 AS average_rating, coalesce(n, 0) AS rating_number
FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) s
  ON l_partkey = p_partkey""",
    ),
    "prod_tags": (
        ("prod",),
        f"""SELECT *, {tags('corpus', V.MATERIALS)} AS mats, {tags('corpus', V.COLORS)} AS cols FROM (
  SELECT *, array_to_string(list_concat([title], features, detail_items, categories, [store]), ' ') AS corpus FROM prod)""",
    ),
    "prod_all": (
        ("prod_tags",),
        f"""SELECT *, {dedup('cleaned')} AS all_constraints FROM (
  SELECT *, list_filter(list_transform(priced, lambda x: {clean('x')}), lambda x: x <> '') AS cleaned FROM (
  SELECT *, CASE WHEN price IS NULL THEN tinted ELSE list_concat(tinted, ['budget around $' || price::VARCHAR]) END AS priced FROM (
  SELECT *, CASE WHEN len(cols) > 0 THEN list_concat(led[1:1], ['color: ' || cols[1]], led[2:]) ELSE led END AS tinted FROM (
  SELECT *, CASE WHEN len(mats) > 0 THEN list_concat(mats[1:1], base) ELSE base END AS led FROM (
  SELECT *, list_concat(features, detail_items) AS base FROM prod_tags)))))""",
    ),
    "prod_cons": (
        ("prod_all",),
        f"""SELECT *, CASE WHEN len(all_constraints) > 0 THEN all_constraints[1:4] ELSE [{clean('title')}] END AS cons,
  {coarse('categories')} AS category FROM prod_all""",
    ),
    "facts": (
        ("prod_cons",),
        """SELECT attribute, normalized_value, parent_asin, arg_min(display_value, ordinal) AS display_value, min(ordinal) AS ordinal
FROM (SELECT attribute, parent_asin, display_value, ordinal - 1 AS ordinal, """
        + norm("display_value")
        + """ AS normalized_value FROM (
  SELECT attribute, parent_asin, unnest(vals) AS display_value, generate_subscripts(vals, 1) AS ordinal FROM (
    SELECT attribute, parent_asin, """
        + dedup("vals")
        + """ AS vals FROM ("""
        + " UNION ALL ".join(
            f"SELECT '{a}' AS attribute, parent_asin, {v} AS vals FROM prod_cons"
            for a, v in {
                "category": "flatten(list_transform(categories, lambda x, i: [x, array_to_string(categories[1:i], ' > ')]))",
                "brand": "[store, store]",
                "other": "cons",
                "material": "list_concat(mats, list_filter(cons, lambda x: " + classify("x", V.COLORS) + " = 'material'))",
                "color": "list_concat(cols, list_filter(cons, lambda x: " + classify("x", V.COLORS) + " = 'color'))",
                "budget": "list_concat(CASE WHEN price IS NULL THEN [] ELSE [format('{:.2f}', price)] END, "
                "list_filter(cons, lambda x: " + classify("x", V.COLORS) + " = 'budget'))",
                **{
                    k: "list_filter(cons, lambda x: " + classify("x", V.COLORS) + f" = '{k}')"
                    for k in ("size", "style", "use_case", "feature")
                },
            }.items()
        )
        + """)))) GROUP BY 1, 2, 3""",
    ),
    "bridge": (
        ("prod",),
        """SELECT parent_asin, categories[i] AS name, array_to_string(categories[1:i], ' > ') AS full_path,
  CASE WHEN i > 1 THEN array_to_string(categories[1:i - 1], ' > ') END AS parent_path,
  i - 1 AS position, i = len(categories) AS is_leaf
FROM (SELECT *, unnest(generate_series(1, len(categories))) AS i FROM prod)""",
    ),
    "nodes": (
        ("bridge",),
        """SELECT full_path, min(name) AS name, min(parent_path) AS parent_path, min(position) AS depth,
  count(*) AS product_count, lower(min(name)) AS normalized_name FROM bridge GROUP BY 1""",
    ),
    "profile": (
        ("prod_cons",),
        f"""SELECT parent_asin, category, list_concat(t[1:2], CASE WHEN len(t) > 2 THEN t[3:4] ELSE t[1:1] END) AS constraints,
  lower(store) AS brand, {price_bucket('price')} AS price_bucket, {rating_bucket('average_rating')} AS rating_bucket,
  {popularity_bucket('rating_number')} AS popularity_bucket, least(len(t), 2) AS hard_count
FROM (SELECT *, list_transform(cons, lambda c: {{'attribute': {classify('c')}, 'value': {norm(clean('c', None))}, 'display': c}}) AS t
  FROM prod_cons)""",
    ),
    "reply": (
        ("profile",),
        """SELECT parent_asin, i - 1 AS ordinal, constraints[i].attribute AS attribute, constraints[i].value AS normalized_value
FROM (SELECT *, unnest(generate_series(1, len(constraints))) AS i FROM profile)""",
    ),
    "sess": (
        (),
        f"""SELECT o_orderkey AS session_id, {PID.format('l_partkey')} AS target,
  CASE WHEN o_orderkey % 20 < 8 THEN 'buying' WHEN o_orderkey % 20 < 16 THEN 'browsing'
       WHEN o_orderkey % 20 < 17 THEN 'boundary' ELSE 'intent_override' END AS scenario
FROM orders JOIN (SELECT l_orderkey, l_partkey,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) t
  ON l_orderkey = o_orderkey AND rn = 1""",
    ),
    "states": (
        ("sess", "profile"),
        """SELECT session_id, target, scenario, category, turn, constraints[1:turn] AS known
FROM (SELECT s.*, p.category, p.constraints, unnest([1, 2, 3, 4]) AS turn FROM sess s JOIN profile p ON p.parent_asin = s.target)""",
    ),
    "messages": (
        ("sess", "profile"),
        """SELECT session_id, scenario, turn, CASE
  WHEN turn = 1 AND scenario = 'buying' THEN 'I''m looking for ' || category || '. A key requirement is: ' || shown[1] || '.'
  WHEN turn = 1 AND scenario = 'intent_override' THEN 'I''m looking for ' || category || '. ' || shown[-1]
  WHEN turn = 1 THEN 'I''m looking for ' || category || ', but I''m still exploring.'
  WHEN scenario = 'boundary' AND turn = 2 THEN 'I don''t have a preference for use_case; please use your judgment.'
  WHEN scenario = 'intent_override' AND turn = 3 THEN 'Actually, ignore my earlier preference. What I need is: ' || shown[1] || '.'
  WHEN turn = 4 THEN 'I don''t have an additional preference for color.'
  ELSE 'For that, what matters is: ' || array_to_string(shown[turn - 1:turn], '; ') || '.' END AS text
FROM (SELECT s.session_id, s.scenario, p.category, list_transform(p.constraints, lambda c: c.display) AS shown,
  unnest([1, 2, 3, 4]) AS turn FROM sess s JOIN profile p ON p.parent_asin = s.target)""",
    ),
    "free": (
        ("sess", "profile"),
        """SELECT message_id, CASE message_id % 12
  WHEN 0 THEN 'Looking for a ' || word || ' under $1,2' || n || ', not leather or ' || material
  WHEN 1 THEN 'black or white ' || word || ' for jogging please'
  WHEN 2 THEN 'Black and white ' || word || 's, up to $' || n
  WHEN 3 THEN 'faux leather ' || word || ' with no ' || material
  WHEN 4 THEN 'any color is fine, size 9 or 10, ' || material || ' shirt'
  WHEN 5 THEN 'footwear for road runners from ' || brand
  WHEN 6 THEN brand || ' ' || word || ', my budget is $' || n
  WHEN 7 THEN 'show me some cool things for the beach'
  WHEN 8 THEN 'cheap waterproof ' || word || ' without ' || material
  WHEN 9 THEN 'black tie ' || word || ' in navy blue'
  WHEN 10 THEN 'I don''t care about the brand, ' || material || ' ' || word || ' size ' || n
  ELSE 'either comfy or lightweight ' || word || ' instead of ' || material END AS text
FROM (SELECT session_id AS message_id, split_part(category, ' ', 2) AS word, session_id % 90 + 10 AS n, 'Brand#' || (session_id % 25 + 1) AS brand,
  (["""
        + quoted(V.MESSAGE_MATERIALS)
        + """])[session_id % 8 + 1] AS material FROM sess JOIN profile ON parent_asin = target)""",
    ),
    "edits": (
        (),
        """SELECT user_id AS session_id, ts, event_id, CASE event_type WHEN 'view' THEN 'set' WHEN 'click' THEN 'alternatives'
  WHEN 'error' THEN 'exclude' WHEN 'signup' THEN 'clear' ELSE 'remove' END AS op,
  (['material', 'color', 'size', 'style', 'brand'])[(floor(value)::BIGINT % 5) + 1] AS attribute,
  'v' || json_extract_string(props, '$.k') AS value FROM events""",
    ),
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the views it needs, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in VIEWS[name][0]:
            add(needed)
        ordered.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered)
    return f"WITH {ctes}\n{body}" if ordered else body
