"""The registered queries as SQL, written apart from the Spark code.

Results are found the long way here: union of price rows, then row_number per
product; ranks by a window over the whole frame; bins by a join with their
edges.
"""

from __future__ import annotations

from shelfgauge.operators.filters import COFFEE_PODS, NOT_PEANUT_BUTTER
from shelfgauge.plans import fixed_repairs
from verification.surrogate import ENDINGS, KNOWN_SIZES, PACK_BRAND_CODE


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows, *columns: str) -> str:
    listed = ", ".join("(" + ", ".join(v if isinstance(v, str) and v.isdigit() else text(v) for v in row) + ")"
                       for row in rows)
    return f"(values {listed}) as v({', '.join(columns)})"


def pick(options, index: str) -> str:
    return f"([{', '.join(text(o) for o in options)}])[{index} + 1]"


# Inputs

PRODUCTS = f"""
products as (
  select p_partkey, p_type as category,
    coalesce(rule_description, concat(p_name, {pick(ENDINGS, '((p_partkey // 16) % 16)')})) as description,
    case when p_brand = '{PACK_BRAND_CODE}' then {text(fixed_repairs.PACK_BRAND)} else p_brand end as brand,
    coalesce(rule_size, case p_partkey % 16
      when 0 then 'each' when 1 then '1 each' when 2 then '1/2 gal' when 3 then 'large dozen'
      when 4 then null
      when 5 then concat(p_size, ' ct') when 6 then concat(p_size, 'ct')
      when 7 then concat(p_size, ' lb') when 8 then concat(p_size, ' fl oz')
      when 9 then concat(p_size, ' qt') when 10 then concat(p_size, ' l')
      when 11 then concat(p_size, ' rolls')
      when 12 then concat(1 + p_size % 6, ' ct / ', p_size, ' oz')
      when 13 then concat(p_size, '.5 oz.') when 14 then concat(p_size, ' oz')
      else {pick(KNOWN_SIZES, '((p_partkey // 16) % 10)')} end) as size
  from part left join {values(
      [(str(i), name, size) for i, (name, size, _) in enumerate(fixed_repairs.MEAT_REPAIRS)],
      'rule', 'rule_description', 'rule_size')}
    on p_partkey % 16 = 12 and (p_partkey // 16) % 4 = 3 and (p_partkey // 64) % {len(fixed_repairs.MEAT_REPAIRS)} = rule
)"""

OFFERS = PRODUCTS + """,
lines as (
  select category, l_suppkey as store_id, description, brand, size, l_extendedprice as regular,
    case when l_linenumber = 7 then cast(null as double)
         when l_discount = 0 then cast(0 as double)
         else floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 end as promo,
    l_linenumber
  from lineitem join products on l_partkey = p_partkey
),
offers as (select * exclude (l_linenumber) from lines)"""

STORES = """
stores as (
  select cast(s_suppkey as varchar) as location_id, n_name as chain, s_name as address_line1,
    r_name as city, s_suppkey
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""


def over_offers(select: str, *steps: str) -> str:
    return "with " + ",\n".join([OFFERS, *steps]) + "\n" + select


# Sizes

def number(expression: str) -> str:
    return (f"case when regexp_matches({expression}, '^([0-9]+[.]?[0-9]*|[.][0-9]+)$') "
            f"then try_cast({expression} as double) end")


AMOUNT = number("split_part(size, ' ', 1)")
UNIT = "substr(size, strpos(size, ' ') + 1)"
WORDS = "list_filter(string_split_regex(size, '\\s+'), lambda w: w <> '')"
FIRST = number("words[1]")


def last_is(unit: str, lengths: str) -> str:
    return f"(words[-1] = '{unit}' or words[-1] = '{unit}.') and len(words) in ({lengths})"


OZ = {
    "none": "cast(null as double)",
    "weight": f"case when contains(unit, 'oz') then amount when contains(unit, 'lb') then amount * 16::double end",
    "any": """case when contains(unit, 'oz') then amount when contains(unit, 'lb') then amount * 16::double
                   when contains(unit, 'qt') then amount * 32::double
                   when contains(unit, 'gal') then amount * 128::double
                   when unit in ('l', 'l.') then amount * 33.81::double end""",
    "liquid": f"""case when {last_is('oz', '2, 3')} then first_number
                       when {last_is('qt', '2')} then first_number * 32::double
                       when {last_is('l', '2')} then first_number * 33.81::double
                       when {last_is('gal', '2')} then first_number * 128::double end""",
    "tea": f"""case when {last_is('oz', '2, 3')} then first_number
                    when {last_is('gal', '2')} then first_number * 128::double end""",
    "ounces": f"case when {last_is('oz', '2, 3')} then first_number end",
}
COUNT = {
    "none": "cast(null as double)",
    "text": "case when regexp_matches(unit, 'bunch|ct|each|pk|roll') then amount end",
    "word": f"""case when words[-1] = 'ct' and len(words) = 2 then first_number
                     when words[1] like '%ct'
                     then {number("substr(words[1], 1, length(words[1]) - 2)")} end""",
}


def size_step(oz: str, count: str, source: str = "offers", target: str = "sized", count_unit: str = "each") -> str:
    columns = ([f"{OZ[oz]} as size_oz"] if oz != "none" else []) + (
        [f"{COUNT[count]} as size_{count_unit}"] if count != "none" else [])
    return f"""
{target} as (
  select * exclude (amount, unit, words, first_number), {', '.join(columns)}
  from (select *, {FIRST} as first_number
        from (select *, {AMOUNT} as amount, {UNIT} as unit, {WORDS} as words from {source}) as a) as b
)"""


def price_step(*units: str, source: str = "sized", target: str = "priced") -> str:
    prices = ", ".join(
        f"regular / nullif(size_{u}, 0) as regular_per_size_{u}, promo / nullif(size_{u}, 0) as promo_per_size_{u}"
        for u in units)
    changes = ", ".join(
        f"(promo_per_size_{u} - regular_per_size_{u}) / nullif(regular_per_size_{u}, 0) * 100"
        f" as pct_change_regular_to_promo_size_{u}" for u in units)
    return f"{target} as (select *, {changes} from (select *, {prices} from {source}) as p)"


def complete(unit: str) -> str:
    return (f"description is not null and size is not null and regular is not null and promo is not null"
            f" and regular_per_size_{unit} is not null"
            f" and pct_change_regular_to_promo_size_{unit} is not null")


FRAME = "category, store_id"


def rows_step(unit: str, source: str = "priced", target: str = "price_rows", columns: str = FRAME) -> str:
    shown = f"{columns}, description, size, regular, promo"
    pct = f"pct_change_regular_to_promo_size_{unit}"
    return f"""
{target} as (
  select {shown}, regular_per_size_{unit} as per_size_{unit}, {pct} from {source} where {complete(unit)}
  union all
  select {shown}, promo_per_size_{unit} as per_size_{unit}, {pct} from {source}
  where {complete(unit)} and promo_per_size_{unit} > 0
)"""


def best_step(unit: str, frame: str = FRAME, source: str = "price_rows", target: str = "best") -> str:
    return f"""
{target} as (
  select {frame}, description, size, regular, promo, per_size_{unit}, pct_change_regular_to_promo_size_{unit}
  from (select *, row_number() over (partition by {frame}, description
                                     order by per_size_{unit}, regular, promo, size) as place
        from {source}) as r
  where place = 1
)"""


def best_steps(oz: str, count: str, unit: str, frame: str = FRAME, count_unit: str = "each",
               source: str = "offers", prefix: str = "") -> list[str]:
    n = {k: prefix + k for k in ("sized", "priced", "price_rows", "best")}
    units = (["oz"] if oz != "none" else []) + ([count_unit] if count != "none" else [])
    return [
        size_step(oz, count, source, n["sized"], count_unit),
        price_step(*units, source=n["sized"], target=n["priced"]),
        rows_step(unit, n["priced"], n["price_rows"]),
        best_step(unit, frame, n["price_rows"], n["best"]),
    ]


def ranked(unit: str, frame: str = FRAME, source: str = "best") -> str:
    within = f"partition by {frame} " if frame else ""
    return (f"select *, cast(dense_rank() over ({within}order by per_size_{unit}) as double) as per_size_rank"
            f" from {source}")


# Repairs

def by_size(rules, source: str, target: str) -> str:
    cases = " ".join(f"when {text(old)} then {text(new)}" for old, new in rules)
    return f"{target} as (select * replace (case size {cases} else size end as size) from {source})"


def by_product(rules, source: str, target: str) -> str:
    cases = " ".join(
        f"when description = {text(name)} and size = {text(old)} then {text(new)}" for name, old, new in rules)
    return f"{target} as (select * replace (case {cases} else size end as size) from {source})"


CT_AND_OZ = "contains(size, 'ct') and contains(size, 'oz')"
IS_TEA_BAGS = "regexp_matches(description, 'Tea Bags|Teabags')"
TRUNCATED = f"case when {IS_TEA_BAGS} and {CT_AND_OZ} then regexp_extract(size, '^(.*?ct)', 1) else size end"
MULTIPLIED = f"""coalesce(case when {CT_AND_OZ} then
  cast(({number(WORDS + '[1]')}) * ({number(WORDS + '[4]')}) as varchar) || ' ' || ({WORDS})[-1] end, size)"""


def rewrite(expression: str, source: str, target: str) -> str:
    return f"{target} as (select * replace ({expression} as size) from {source})"


PACK_TOTAL_TEXT = "replace(replace(replace(size, 'ct', ''), 'oz', ''), ' ', '')"
PACK_TOTAL = f"""case when brand = {text(fixed_repairs.PACK_BRAND)} and contains(size, '/') and {CT_AND_OZ}
  then ({number(f"split_part({PACK_TOTAL_TEXT}, '/', 1)")}) * ({number(f"split_part({PACK_TOTAL_TEXT}, '/', 2)")}) end"""

NO_PODS = f"len(regexp_extract_all(description, '{COFFEE_PODS}')) = 0"
IS_PEANUT_BUTTER = " and ".join(f"not contains(description, {text(word)})" for word in NOT_PEANUT_BUTTER)


def keep(condition: str, source: str, target: str) -> str:
    return f"{target} as (select * from {source} where {condition})"


SOLD_BY_COUNT = "right(size, 2) = 'ct'"
IS_EGG = "regexp_matches(description, '(?i)egg')"

# Pages: what the searches list, found without JSON.

LISTED = """
listed as (
  select category, cast(store_id as varchar) as store_id, description, brand, size, regular, promo, 1 as place, l_linenumber
  from lines where l_linenumber < 6
  union all
  select category, cast(store_id as varchar), description, brand,
    case when l_linenumber = 2 then size end, cast(null as double), cast(null as double), 2, l_linenumber
  from lines where l_linenumber in (1, 2)
)"""
LISTED_COLUMNS = "category, store_id, description, brand, size, regular, promo"


# Pages of whole searches: what is found of them, without JSON.
SEARCH_PAGES = """
searches as (select category, store_id, count(*) as total from lines group by all),
places as (select *, unnest(range(0, total, 50)) as start from searches),
judged as (
  select *, least(50, total - start) as n, start + 50 >= total as is_last,
    case when start = 50 and store_id % 3 = 0 then 'gone'
         when start = 0 and store_id % 7 = 3 then 'error page'
         when start + 50 >= total and store_id % 11 = 5 then 'unreadable'
         else 'page' end as kind,
    case when start = 0 and store_id % 2 = 0 then 2 else 1 end as copies
  from places),
known as (select category, store_id, bool_or(kind = 'page') as told from judged group by all)"""


def histogram() -> str:
    """Bins by joining prices with all edges of their frame."""
    key, group, join_edges = "category, ", "group by category", "join edges using (category)"
    return f"""
spread as (
  select {key}count(*) as n, min(per_size_oz) as least, max(per_size_oz) as greatest,
    quantile_cont(per_size_oz, 0.25) as q1, quantile_cont(per_size_oz, 0.75) as q3
  from best {group}
),
widths as (
  select *, (greatest - least) / (log2(n) + 1) as sturges, 2 * (q3 - q1) / pow(n, 1.0::double / 3) as fd from spread
),
limits as (
  select {key}
    case when greatest = least then 1
         else cast(ceil((greatest - least) / (case when fd > 0 then least(fd, sturges) else sturges end)) as bigint)
    end as n_bins,
    case when greatest = least then least - 0.5 else least end as low,
    case when greatest = least then greatest + 0.5 else greatest end as high
  from widths
),
numbered as (select {key}n_bins, low, high, unnest(range(n_bins)) as bin from limits),
edges as (
  select {key}n_bins, bin, bin * ((high - low) / n_bins) + low as bin_from,
    case when bin + 1 = n_bins then high else (bin + 1) * ((high - low) / n_bins) + low end as bin_to
  from numbered
)
select {key}n_bins, bin, bin_from, bin_to, count(*) as n
from best {join_edges}
where per_size_oz >= bin_from and (per_size_oz < bin_to or (bin + 1 = n_bins and per_size_oz <= bin_to))
group by {key}n_bins, bin, bin_from, bin_to"""


ALL_LITERAL = (
    *fixed_repairs.VEGETABLE_REPAIRS, *fixed_repairs.MILK_REPAIRS, *fixed_repairs.TEA_REPAIRS,
    *fixed_repairs.EGG_REPAIRS, *fixed_repairs.PEANUT_BUTTER_REPAIRS,
)

WEIGHTS = best_steps("weight", "none", "oz")

# Category jobs: steps up to the repaired table, dialect, count unit, ranked?
PREPARED = {
    "toilet_paper": ([keep("true", "offers", "repaired")], "none", "text", "each", False),
    "vegetables": ([by_size(fixed_repairs.VEGETABLE_REPAIRS, "offers", "repaired")], "weight", "text", "each", False),
    "fruit": ([by_size(fixed_repairs.FRUIT_REPAIRS, "offers", "repaired")], "weight", "text", "each", False),
    "coffee": ([keep("true", "offers", "repaired")], "weight", "none", "each", False),
    "decaf_coffee": ([keep(NO_PODS, "offers", "repaired")], "weight", "none", "each", False),
    "creamer": ([keep("true", "offers", "repaired")], "any", "none", "each", True),
    "milk": ([by_size(fixed_repairs.MILK_REPAIRS, "offers", "repaired")], "liquid", "none", "each", True),
    "tea": ([rewrite(TRUNCATED, "offers", "cut"), by_size(fixed_repairs.TEA_REPAIRS, "cut", "repaired")],
            "tea", "word", "ct", True),
    "salad_dressing": ([rewrite(MULTIPLIED, "offers", "repaired")], "ounces", "word", "each", True),
    "eggs": ([keep(IS_EGG, "offers", "chosen"), by_size(fixed_repairs.EGG_REPAIRS, "chosen", "dozens"),
              keep(SOLD_BY_COUNT, "dozens", "repaired")], "none", "word", "each", True),
    "peanut_butter": ([keep(IS_PEANUT_BUTTER, "offers", "chosen"),
                       by_size(fixed_repairs.PEANUT_BUTTER_REPAIRS, "chosen", "repaired")],
                      "ounces", "none", "each", True),
}


def category_steps(name: str, unit: str, prefix: str = "") -> list[str]:
    prepare, oz, count, count_unit, _ = PREPARED[name]
    renamed = [step.replace(" repaired as", f" {prefix}repaired as") if not step.startswith("repaired")
               else prefix + step for step in prepare]
    return [*renamed, *best_steps(oz, count, unit, count_unit=count_unit, source=f"{prefix}repaired", prefix=prefix)]


def category_job(name: str, unit: str) -> str:
    return over_offers(ranked(unit) if PREPARED[name][4] else "select * from best", *category_steps(name, unit))


def merged_job(first: str, second: str, unit: str, select: str | None = None) -> str:
    merged = f"""
merged as (
  select {FRAME}, description, size, regular, promo, per_size_{unit}, pct_change_regular_to_promo_size_{unit}
  from (select *, row_number() over (partition by {FRAME}, description, size order by source) as place
        from (select *, 1 as source from a_best union all select *, 2 as source from b_best) as u) as p
  where place = 1
),
merged_ranked as ({ranked(unit, source='merged')})"""
    return over_offers(select or "select * from merged_ranked",
                       *category_steps(first, unit, "a_"), *category_steps(second, unit, "b_"), merged)


# All categories at once: the part types and how each is treated.
CATALOGUE = {
    "vegetables": ("ECONOMY",), "salad_dressing": ("LARGE",), "tea": ("MEDIUM", "PROMO"),
    "eggs": ("SMALL",), "milk": ("STANDARD",),
}


def catalogue_steps() -> list[str]:
    steps, parts, parsed = [], [], []
    for name, terms in CATALOGUE.items():
        prepare, oz, count, count_unit, _ = PREPARED[name]
        p = name[0] + "_"
        listed = ", ".join(text(t) for t in terms)
        steps.append(f"{p}offers as (select * replace ({text(name.replace('_', ' '))} as category)"
                     f" from offers where category in ({listed}))")
        for step in prepare:
            for old in ("offers", "cut", "chosen", "dozens"):
                step = step.replace(f"from {old}", f"from {p}{old}")
            steps.append(p + step)
        units = (["oz"] if oz != "none" else []) + ([count_unit] if count != "none" else [])
        steps.append(size_step(oz, count, f"{p}repaired", f"{p}sized", count_unit))
        oz_column = "size_oz" if oz != "none" else "cast(null as double) as size_oz"
        count_column = f"size_{count_unit}" if count != "none" else "cast(null as double)"
        parsed.append(f"""select {FRAME}, description, brand, size, regular, promo, {oz_column},
          {count_column} as size_count, '{count_unit}' as count_unit from {p}sized""")
        steps.append(price_step(*units, source=f"{p}sized", target=f"{p}priced"))
        for unit in units:
            q = f"{p}{unit}_"
            steps.append(rows_step(unit, f"{p}priced", f"{q}rows"))
            steps.append(best_step(unit, FRAME, f"{q}rows", f"{q}best"))
            parts.append(f"""select {FRAME}, '{unit}' as unit, description, size, regular, promo,
              per_size_{unit} as per_size_unit,
              pct_change_regular_to_promo_size_{unit} as pct_change_regular_to_promo_size_unit from {q}best""")
    return [*steps, "best as (" + "\nunion all\n".join(parts) + ")",
            "parsed as (" + "\nunion all\n".join(parsed) + ")"]


# All recipes: the search terms in their order, a store's offers standing for those of a term.
TERMS = (
    "toilet_paper", "vegetables", "fruit", "meat", "coffee", "decaf_coffee", "laundry_detergent", "creamer", "milk",
    "tea", "tea", "salad_dressing", "eggs", "peanut_butter",
)
PARSED_ONLY = {
    "meat": ([by_product(fixed_repairs.MEAT_REPAIRS, "offers", "repaired")], "none", "none", "each"),
    "laundry_detergent": ([keep("true", "offers", "repaired")], "weight", "none", "each"),
}


def all_recipes() -> str:
    steps, parsed = [], []
    for name in dict.fromkeys(TERMS):
        prepare, oz, count, count_unit = (PARSED_ONLY.get(name) or PREPARED[name])[:4]
        places = ", ".join(str(i) for i, term in enumerate(TERMS) if term == name)
        steps.append(f"{name}_offers as (select * from offers where store_id % {len(TERMS)} in ({places}))")
        for step in prepare:
            for old in ("offers", "cut", "chosen", "dozens"):
                step = step.replace(f"from {old}", f"from {name}_{old}")
            steps.append(f"{name}_{step}")
        sized = f"{name}_repaired"
        if (oz, count) != ("none", "none"):
            sized = f"{name}_sized"
            steps.append(size_step(oz, count, f"{name}_repaired", sized, count_unit))
        parsed.append(f"""select {text(name.replace('_', ' '))} as term, {FRAME}, description, brand, size, regular, promo,
          {PACK_TOTAL if name == 'meat' else 'cast(null as double)'} as pack_total,
          {'size_oz' if oz != 'none' else 'cast(null as double)'} as size_oz,
          {f'size_{count_unit}' if count != 'none' else 'cast(null as double)'} as size_count,
          '{count_unit}' as count_unit from {sized}""")
    return over_offers("\nunion all\n".join(parsed), *steps)


def merged_catalogue() -> str:
    first = """
first as (
  select * exclude (place, source) from (
    select *, row_number() over (partition by store_id, unit, description, size order by source) as place
    from (select *, 1 as source from best where category = 'vegetables'
          union all select *, 2 as source from best where category = 'milk') as u) as p
  where place = 1
)"""
    return over_offers(ranked("unit", "store_id, unit", "first"), *catalogue_steps(), first)


PLACE = "category, store_id, description, size"

ORACLE_SQL: dict[str, str] = {
    "ingest_pages_flatten": over_offers(f"select {LISTED_COLUMNS} from listed", LISTED),
    "ingest_skip_error_pages": over_offers("""
        select category as term, cast(store_id as varchar) as store, count(*) as n_pages,
          count(*) filter (where l_linenumber < 6) as n_good_pages,
          cast(sum(case when l_linenumber < 3 then 2 when l_linenumber < 6 then 1 else 0 end) as bigint) as n_products
        from lines group by 1, 2"""),
    "ingest_completeness": over_offers("""
        select category as term, cast(store_id as varchar) as store,
          cast(max(case when l_linenumber < 3 then 2 when l_linenumber < 6 then 1 end) as bigint) as announced,
          cast(sum(case when l_linenumber < 3 then 2 when l_linenumber < 6 then 1 else 0 end) as bigint) as received
        from lines group by 1, 2"""),
    "ingest_multi_term_union": over_offers(f"""
        select {LISTED_COLUMNS.replace('category,', "'both' as category,")}
        from listed where category in ('ECONOMY', 'SMALL')""", LISTED),
    "ingest_partition_filter": over_offers(
        f"select {LISTED_COLUMNS} from listed where category in ('ECONOMY', 'SMALL')", LISTED),
    "ingest_latest_run": over_offers(f"select {LISTED_COLUMNS} from listed", LISTED),
    "ingest_page_report": over_offers("""
        select category as term, cast(store_id as varchar) as store, count(*) as n_pages,
          count(*) filter (where l_linenumber >= 6) as n_without_data,
          cast(max(case when l_linenumber < 3 then 2 when l_linenumber < 6 then 1 end) as bigint) as announced,
          cast(sum(case when l_linenumber < 3 then 2 when l_linenumber < 6 then 1 else 0 end) as bigint) as received,
          count(*) filter (where l_linenumber < 3) as n_without_price
        from lines group by 1, 2"""),
    "ingest_page_gaps": over_offers("""
        select category as term, cast(store_id as varchar) as store, cast(start as bigint) as start,
          case when told then cast(n as bigint) end as expected, cast(0 as bigint) as received
        from judged join known using (category, store_id) where kind <> 'page' and (told or start = 0)""", SEARCH_PAGES),
    "ingest_page_kinds": over_offers("""
        select category as term, cast(store_id as varchar) as store,
          cast(coalesce(sum(copies) filter (where kind = 'page'), 0) as bigint) as n_pages,
          cast(coalesce(sum(copies) filter (where kind = 'error page'), 0) as bigint) as n_error_pages,
          cast(coalesce(sum(copies) filter (where kind = 'unreadable'), 0) as bigint) as n_unreadable
        from judged where kind <> 'gone' group by 1, 2""", SEARCH_PAGES),
    "ingest_quarantine": over_offers("""
        select category as term, kind, cast(sum(copies) as bigint) as n, cast(0 as bigint) as n_without_file,
          case when kind = 'unreadable' then cast(40 * sum(copies) as bigint) end as n_chars
        from judged where kind in ('error page', 'unreadable') group by 1, 2""", SEARCH_PAGES),
    "ingest_stored_offers": over_offers(
        f"select '2026-01-01' as run, {LISTED_COLUMNS} from listed where category in ('ECONOMY', 'SMALL')", LISTED),
    "store_lookup": f"""with {STORES} select location_id from stores
        where s_suppkey % 3 = 1 and regexp_matches(address_line1, '#0+[1-9][0-9]*$') and city = 'ASIA'
        order by location_id limit 1""",
    "store_flatten": f"with {STORES} select location_id, chain, address_line1, city from stores",
    "store_match_first": f"""with {STORES} select location_id from stores
        where regexp_matches(address_line1, '#0+[1-9][0-9]*$') and city = 'ASIA' order by s_suppkey limit 1""",
    "size_oz_substring": over_offers("select * from sized", size_step("weight", "none")),
    "size_each_substring": over_offers("select * from sized", size_step("none", "text")),
    "size_oz_units": over_offers("select * from sized", size_step("any", "none")),
    "size_oz_exact": over_offers("select * from sized", size_step("liquid", "none")),
    "size_ct_exact": over_offers("select * from sized", size_step("tea", "word", count_unit="ct")),
    "repair_literal": over_offers("select * from repaired", by_size(ALL_LITERAL, "offers", "repaired")),
    "repair_keyed": over_offers("select * from repaired",
                                by_product(fixed_repairs.MEAT_REPAIRS, "offers", "repaired")),
    "repair_by_table": over_offers("""
        select f.category, store_id, f.description, brand, coalesce('about ' || s.size, f.size) as size, regular, promo
        from first f left join shared s on s.category = f.category and s.size = f.size""", """
own as (
  select category, description, size, cast(max(p_partkey) as varchar) || ' oz' as new_size from products
  where p_partkey % 3 = 0 and description is not null and size is not null group by 1, 2, 3),
shared as (select distinct category, size from products where size like '% ct'),
first as (
  select o.category, store_id, o.description, brand, coalesce(w.new_size, o.size) as size, regular, promo
  from offers o left join own w on w.category = o.category and w.description = o.description and w.size = o.size)"""),
    "repair_truncate_ct": over_offers("select * from repaired", rewrite(TRUNCATED, "offers", "repaired")),
    "repair_compound": over_offers("select * from repaired", rewrite(MULTIPLIED, "offers", "repaired")),
    "repair_brand_compound": over_offers(f"select *, {PACK_TOTAL} as pack_total from offers"),
    "unit_price_columns": over_offers("select * from priced", size_step("weight", "text"), price_step("oz", "each")),
    "drop_incomplete": over_offers(f"select * from priced where {complete('oz')}",
                                   size_step("weight", "none"), price_step("oz")),
    "price_rows_oz": over_offers("select * from price_rows", *WEIGHTS[:3]),
    "best_price_oz": over_offers(ranked("oz", "category"), *best_steps("any", "none", "oz", "category")),
    "best_price_each": over_offers("select * from best", *best_steps("none", "text", "each")),
    "best_price_ct": over_offers("select * from best", *best_steps("tea", "word", "ct", count_unit="ct")),
    "stamp_run_rows": over_offers(
        "select *, timestamp '2026-01-01 20:04:05' as runtime_mst from best", *WEIGHTS),
    "dense_price_rank": over_offers(ranked("oz"), *WEIGHTS),
    "dense_price_rank_sliced": over_offers(ranked("oz", "category"), *WEIGHTS),
    "dense_price_rank_global": over_offers(ranked("oz", ""), *WEIGHTS),
    "rank_frequency": over_offers(f"""select category, per_size_rank, count(*) as n
        from ({ranked('oz', 'category')}) as r group by 1, 2""", *WEIGHTS),
    "group_mean": over_offers(f"""select {PLACE},
        cast(sum(cast(regular as decimal(18,2))) over k as double) / count(regular) over k as mean_regular
        from offers window k as (partition by category, description)"""),
    "combine_first_source_wins": over_offers(f"""
        select * exclude (source, place) from (
          select *, row_number() over (partition by {PLACE} order by source) as place
          from (select *, 1 as source from a_best union all select *, 2 as source from b_best) as u) as p
        where place = 1""",
        *best_steps("liquid", "none", "oz", prefix="a_"), *best_steps("any", "none", "oz", prefix="b_")),
    "combine_keep_ranks": over_offers(
        f"{ranked('oz', 'category', 'a_best')} union all {ranked('oz', 'category', 'b_best')}",
        *best_steps("any", "none", "oz", "category", prefix="a_"),
        *best_steps("liquid", "none", "oz", "category", prefix="b_")),
    "size_frequency": over_offers(
        "select category, size, count(*) as n from offers where size is not null group by 1, 2"),
    "unit_frequency": over_offers("""select category, substr(size, strpos(size, ' ') + 1) as unit, count(*) as n
        from offers where contains(size, ' ') group by 1, 2"""),
    "compound_brand_frequency": over_offers(
        "select brand, count(*) as n from offers where contains(size, '/') group by 1"),
    "compound_size_frequency": over_offers(
        "select size, count(*) as n from offers where contains(size, '/') group by 1"),
    "distinct_units": over_offers("""select distinct
        case when contains(size, ' ') then substr(size, strpos(size, ' ') + 1) end as unit from offers"""),
    "names_a_unit": over_offers("""select bool_or(contains(size, ' ') and
        substr(size, strpos(size, ' ') + 1) in ('oz', 'lb', 'qt', 'l', 'gal')) as names_a_unit from offers"""),
    "price_histogram": "with " + ",\n".join([OFFERS, *WEIGHTS, histogram()]),
    "price_histogram_sliced": "with " + ",\n".join(
        [OFFERS, *WEIGHTS[:3], best_step("oz", target="frames"),
         "best as (select * replace ('all' as category) from frames)", histogram()]),
    "report_frequencies": over_offers("""
        select category, report, value, count(*) as n from (
          select category, 'sizes' as report, size as value from sized union all
          select category, 'units', case when contains(size, ' ') then substr(size, strpos(size, ' ') + 1) end from sized union all
          select category, 'compound sizes', size from sized where contains(size, '/') union all
          select category, 'compound brands', brand from sized where contains(size, '/') union all
          select category, 'unparsed sizes', coalesce(size, '') from sized where size_oz is null and size_each is null union all
          select category, 'rows', 'rows' from sized) as r
        where value is not null group by 1, 2, 3""", size_step("weight", "text")),
    "price_reports": over_offers(f"""select {FRAME}, unit, per_size_rank, count(*) as n
        from ({ranked('unit', FRAME + ', unit')}) as r group by all""", *catalogue_steps()),
    "frame_shape": over_offers("select count(*) as n_rows, cast(7 as bigint) as n_columns from offers"),
    "audit_unparsed": over_offers(f"select {PLACE} from sized where size_oz is null and size_each is null",
                                  size_step("weight", "text")),
    "audit_compound": over_offers(f"select {PLACE} from offers where contains(size, '/')"),
    "audit_bare_each": over_offers(f"select {PLACE} from offers where size = 'each'"),
    "keep_any_size": over_offers("select * from sized where size_oz is not null or size_each is not null",
                                 size_step("weight", "text")),
    "sort_description": over_offers(
        "select * from offers where contains(size, '/') order by description desc"),
    "exclude_regex": over_offers(f"select * from offers where {IS_PEANUT_BUTTER}"),
    "exclude_findall": over_offers(f"select * from offers where {NO_PODS}"),
    "contains_ci": over_offers(f"select * from offers where {IS_EGG}"),
    "suffix_filter": over_offers(f"select * from offers where {SOLD_BY_COUNT}"),
    "unit_part": over_offers(f"""select size, split_part(size, ' ', 1) as amount,
        case when contains(size, ' ') then substr(size, strpos(size, ' ') + 1) end as unit,
        cast(len(words) as bigint) as n_words, words[1] as first_word, words[-1] as last_word
        from (select distinct size, {WORDS} as words from offers) as t"""),
    "sink_roundtrip": over_offers("select * from best", *WEIGHTS),
    "run_time_in_zone": """select event_id,
        ts at time zone 'UTC' at time zone 'US/Mountain' as wall_time from events""",
    "job_produce_oz": merged_job("vegetables", "fruit", "oz"),
    "job_produce_each": merged_job("vegetables", "fruit", "each"),
    "job_all_coffee": merged_job("coffee", "decaf_coffee", "oz"),
    "job_all_coffee_ranks": merged_job(
        "coffee", "decaf_coffee", "oz",
        "select per_size_rank, count(*) as n from merged_ranked group by 1"),
    "job_creamer_and_milk": over_offers(
        f"{ranked('oz', source='a_best')} union all {ranked('oz', source='b_best')}",
        *category_steps("creamer", "oz", "a_"), *category_steps("milk", "oz", "b_")),
    "job_meat": over_offers(f"select *, {PACK_TOTAL} as pack_total from repaired",
                            by_product(fixed_repairs.MEAT_REPAIRS, "offers", "repaired")),
    "job_laundry_detergent": over_offers("select * from sized", size_step("weight", "none")),
    "job_all_categories": over_offers(ranked("unit", FRAME + ", unit"), *catalogue_steps()),
    "job_merge_priced": merged_catalogue(),
    "catalogue_parsed": over_offers("select * from parsed", *catalogue_steps()),
    "catalogue_all_recipes": all_recipes(),
    "job_losses": over_offers("""select count(*) as n_offers,
          count(*) filter (where size_oz is null and size_count is null) as n_unparsed,
          count(*) filter (where regular is null or promo is null) as n_without_price,
          count(*) filter (where not coalesce(description is not null and promo is not null and regular <> 0
            and coalesce(nullif(size_oz, 0), nullif(size_count, 0)) is not null, false)) as n_dropped
        from parsed""", *catalogue_steps()),
    "catalogue_unparsed": over_offers("""select category, size, count(*) as n from parsed
        where size_oz is null and size_count is null and size is not null group by 1, 2""", *catalogue_steps()),
}

for _name in PREPARED:
    _, _oz, _count, _count_unit, _ = PREPARED[_name]
    _units = (["oz"] if _oz != "none" else []) + ([_count_unit] if _count != "none" else [])
    for _unit in _units:
        ORACLE_SQL[f"job_{_name}_{_unit}" if len(_units) > 1 else f"job_{_name}"] = category_job(_name, _unit)
