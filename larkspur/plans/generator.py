"""Linked synthetic tables: customers, their fuel transactions and what they buy in the store.

Every value is a hash of seed, stream and row number, so tables need no common random state and come
out the same for any partitioning. Money is counted in cents and fuel in thousandths of a gallon.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.hashing import digest, draw, pick, pick_by_threshold, wide_draw
from larkspur.operators.conversion import customer_conversion
from larkspur.operators.ordering import running_totals
from larkspur.sources.schemas import CUSTOMERS, FUEL_TRANSACTIONS, STORE_PURCHASES

# Fixed values of the generated domain.
TIERS = ("Bronze", "Silver", "Gold", "Platinum")
FUEL_CENTS = {"Regular": 329, "Mid-Grade": 359, "Premium": 389, "Diesel": 369}
PUMPS = 12
PAYMENT_METHODS = ("Credit Card", "Debit Card", "Gift Card", "Rewards", "Cash")
# Category: share in percent, lowest and highest price in cents.
CATEGORIES = {
    "Beverages": (35, 199, 549),
    "Snacks": (25, 99, 499),
    "Hot Food": (15, 299, 899),
    "Tobacco": (10, 799, 1499),
    "Car Care": (8, 399, 2499),
    "Lottery": (4, 100, 2000),
    "Automotive": (3, 499, 3999),
}
MEMBER_PERCENT, TIER_PERCENT, CONVERSION_PERCENT = 60, 60, 38
JOINED_FROM, JOINED_SECONDS = "2020-01-01 00:00:00", 157_852_800
VISITS_FROM, VISITS_SECONDS = "2025-01-01 00:00:00", 31_449_600
MILLI_GALLONS = (3_000, 20_000)
GAP_MINUTES = (2, 15)
MAX_ITEMS, MAX_QUANTITY = 4, 3

# Words for names and products.
FIRST_NAMES = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo", "Iris", "Jon", "Kim", "Leo")
LAST_NAMES = ("Archer", "Baker", "Carter", "Dyer", "Ellis", "Fisher", "Grant", "Hayes", "Ingram", "Jones")
VERBS = ("fresh", "crisp", "daily", "grand", "happy", "prime", "quick", "royal")
ADJECTIVES = ("amber", "bright", "coastal", "golden", "mellow", "rustic", "silver", "velvet")
NOUNS = ("blend", "bundle", "choice", "classic", "delight", "selection", "treat", "value")


@dataclass(frozen=True)
class GeneratorSettings:
    """Table sizes and seed; ``brand`` goes before the names of the two house payment methods."""

    customers: int = 500
    fuel_transactions: int = 5_000
    seed: int = 42
    brand: str = ""

    @property
    def payment_methods(self) -> tuple[str, ...]:
        own = {"Gift Card", "Rewards"}
        return tuple(f"{self.brand} {m}".strip() if m in own else m for m in PAYMENT_METHODS)


def row_numbers(spark: SparkSession, rows: int) -> DataFrame:
    """Row numbers 1 to ``rows`` in column ``n``, the input of the table generators."""
    return spark.range(1, rows + 1).withColumnRenamed("id", "n")


def _between(number: Column, bounds: tuple[int, int]) -> Column:
    low, high = bounds
    return number % (high - low + 1) + low


def _moment(start: str, seconds: Column) -> Column:
    """Wall-clock time, so that all sessions generate the same times whatever their time zone."""
    return F.timestamp_add("SECOND", seconds, F.lit(start).cast("timestamp_ntz"))


def _money(cents: Column) -> Column:
    return cents.cast("double") / 100


def _customer_id(number: Column) -> Column:
    return F.format_string("CUST-%05d", number)


def _fuel_id(number: Column) -> Column:
    return F.format_string("FUEL-%07d", number)


def _is_member(seed: int, number: Column) -> Column:
    return draw(digest(seed, "customer", number), 1) % 100 < MEMBER_PERCENT


def generate_customers(numbers: DataFrame, settings: GeneratorSettings = GeneratorSettings()) -> DataFrame:
    n, seed = F.col("n"), settings.seed
    traits, person, contact = (digest(seed, s, n) for s in ("customer", "person", "contact"))
    first, last = pick(FIRST_NAMES, draw(person, 0)), pick(LAST_NAMES, draw(person, 1))
    tier = F.when(draw(traits, 2) % 100 < TIER_PERCENT, pick(TIERS, draw(traits, 3)))
    return numbers.select(
        _customer_id(n).alias("customer_id"),
        F.concat_ws(" ", first, last).alias("full_name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), n, F.lit("@example.com")).alias("email"),
        F.format_string(
            "%03d-555-%04d", _between(draw(contact, 1), (200, 999)), draw(contact, 2) % 10_000
        ).alias("phone"),
        F.format_string("%05d", _between(draw(contact, 0), (10_000, 99_999))).alias("zip_code"),
        _is_member(seed, n).alias("loyalty_member"),
        tier.alias("loyalty_tier"),
        _moment(JOINED_FROM, draw(traits, 0) % (JOINED_SECONDS + 1)).cast("timestamp").alias("member_since"),
        pick(tuple(FUEL_CENTS), draw(person, 2)).alias("preferred_fuel"),
    ).select(*CUSTOMERS.names)


def generate_fuel_transactions(
    numbers: DataFrame, settings: GeneratorSettings = GeneratorSettings()
) -> DataFrame:
    """One row per number. Whether the customer is a member follows from the same hash as in the
    customer table, so no join is needed."""
    n, seed = F.col("n"), settings.seed
    visit, payment = digest(seed, "fuel", n), digest(seed, "payment", n)
    drawn = numbers.select(
        n,
        (wide_draw(digest(seed, "fuel_customer", n)) % settings.customers + 1).alias("customer"),
        (draw(visit, 0) % len(FUEL_CENTS)).alias("fuel"),
        _between(draw(visit, 1), MILLI_GALLONS).alias("milli"),
        (draw(visit, 2) % (VISITS_SECONDS + 1)).alias("second"),
        _between(draw(visit, 3), (1, PUMPS)).alias("pump"),
        draw(payment, 0).alias("payment"),
    )
    price, milli = pick(tuple(FUEL_CENTS.values()), F.col("fuel")), F.col("milli")
    cost = F.floor((milli * price + 500) / 1000)
    points = F.when(_is_member(seed, F.col("customer")), F.floor(milli / 100)).otherwise(0)
    return drawn.select(
        _fuel_id(n).alias("fuel_txn_id"),
        _customer_id(F.col("customer")).alias("customer_id"),
        _moment(VISITS_FROM, F.col("second")).cast("timestamp").alias("transaction_ts"),
        F.col("pump").cast("int").alias("pump_number"),
        pick(tuple(FUEL_CENTS), F.col("fuel")).alias("fuel_type"),
        (milli / 1000).alias("gallons"),
        _money(price).alias("price_per_gallon"),
        _money(cost).alias("total_fuel_cost"),
        pick(settings.payment_methods, F.col("payment")).alias("payment_method"),
        points.cast("int").alias("loyalty_points_earned"),
    ).select(*FUEL_TRANSACTIONS.names)


def _by_category(chance: Column, field: int) -> Column:
    """Name, lowest or highest price (``field`` 0, 1 or 2) of the category that ``chance`` selects."""
    shares = accumulate(share for share, _, _ in CATEGORIES.values())
    entries = [(name, low, high) for name, (_, low, high) in CATEGORIES.items()]
    return pick_by_threshold(chance, [(limit, entry[field]) for limit, entry in zip(shares, entries)])


def _parts(item: Column) -> Column:
    names = ("category", "price", "quantity", "words")
    return F.struct(*[draw(item, i).alias(name) for i, name in enumerate(names)])


def _line(parts: Column, position: Column) -> Column:
    chance, words = parts["category"] % 100, parts["words"]
    low, high = _by_category(chance, 1), _by_category(chance, 2)
    product = F.concat_ws(
        " ",
        pick(VERBS, words),
        pick(ADJECTIVES, F.floor(words / len(VERBS))),
        pick(NOUNS, F.floor(words / (len(VERBS) * len(ADJECTIVES)))),
    )
    return F.struct(
        (position + 1).alias("k"),
        _by_category(chance, 0).alias("category"),
        F.substring(F.initcap(product), 1, 40).alias("product_name"),
        (parts["price"] % (high - low + 1) + low).alias("cents"),
        _between(parts["quantity"], (1, MAX_QUANTITY)).alias("quantity"),
    )


def generate_store_purchases(
    numbers: DataFrame, settings: GeneratorSettings = GeneratorSettings(), slices: int | None = None
) -> DataFrame:
    """Lines of the baskets of the fuel visits ``numbers`` that go on to the store.

    A basket is built within its row. Purchases and lines are numbered in the order of the visits.
    """
    n, seed = F.col("n"), settings.seed
    entry = digest(seed, "visit", n)
    visits = numbers.select(
        n,
        (draw(entry, 0) % 100).alias("chance"),
        _between(draw(entry, 1), (1, MAX_ITEMS)).cast("int").alias("lines"),
        _between(draw(entry, 2), GAP_MINUTES).alias("gap"),
    ).where(F.col("chance") < CONVERSION_PERCENT)
    visits = running_totals(
        visits.select("n", "lines", "gap"),
        [],
        ["n"],
        {"purchases_before": F.lit(1).cast("bigint"), "lines_before": F.col("lines").cast("bigint")},
        slices,
    )
    # Three steps, so that each line is hashed once and not once per value drawn from it.
    hashed = F.transform(F.sequence(F.lit(1), "lines"), lambda k: digest(seed, "item", n, k))
    baskets = visits.withColumn("items", F.transform(F.transform(hashed, _parts), _line))
    basket = F.aggregate("items", F.lit(0).cast("bigint"), lambda s, i: s + i["cents"] * i["quantity"])
    fuelled = _moment(VISITS_FROM, draw(digest(seed, "fuel", n), 2) % (VISITS_SECONDS + 1))
    customer = wide_draw(digest(seed, "fuel_customer", n)) % settings.customers + 1
    lines = baskets.select(
        F.format_string("STORE-%07d", F.col("purchases_before") + 1).alias("purchase_id"),
        _fuel_id(n).alias("fuel_txn_id"),
        _customer_id(customer).alias("customer_id"),
        F.timestamp_add("MINUTE", F.col("gap"), fuelled).cast("timestamp").alias("store_ts"),
        _money(basket).alias("basket_total"),
        F.col("lines_before"),
        # Baskets are never empty; the outer form keeps the optimiser from testing that by building them twice.
        F.inline_outer("items"),
    )
    return lines.select(
        F.format_string("ITEM-%08d", F.col("lines_before") + F.col("k")).alias("store_item_id"),
        "fuel_txn_id",
        "customer_id",
        "purchase_id",
        "store_ts",
        "category",
        "product_name",
        _money(F.col("cents")).alias("unit_price"),
        F.col("quantity").cast("int").alias("quantity"),
        _money(F.col("cents") * F.col("quantity")).alias("line_total"),
        "basket_total",
    ).select(*STORE_PURCHASES.names)


def _violations(broken: Column) -> Column:
    """Number of rows that break a rule; a rule that cannot be judged counts as broken."""
    return F.count_if(F.coalesce(broken, F.lit(True)))


def _by_rule(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Rows (rule, violations) from one aggregate over ``df``."""
    counted = df.agg(*[F.coalesce(n, F.lit(0)).alias(rule) for rule, n in counts.items()])
    return counted.unpivot([], list(counts), "rule", "violations")


def _cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("bigint")


def _milli() -> Column:
    return F.round(F.col("gallons") * 1000).cast("bigint")


def row_rules() -> dict[str, dict[str, Column]]:
    """Per table the rules that a row alone can break, as numbers of violations."""
    cost = F.floor((_milli() * _cents("price_per_gallon") + 500) / 1000)
    return {
        "fuel_transactions": {"fuel cost": _violations(_cents("total_fuel_cost") != cost)},
        "store_purchases": {"line total": _violations(_cents("line_total") != _cents("unit_price") * F.col("quantity"))},
    }


def check_generated(customers: DataFrame, fuel: DataFrame, store: DataFrame) -> DataFrame:
    """Rows (rule, violations) for the rules the three tables follow; all counts should be 0.

    One pass over the visits and one over the baskets, which bring the counts of their lines.
    """
    rules = row_rules()
    members = customers.select("customer_id", "loyalty_member")
    visits = fuel.join(members, "customer_id", "left")
    points = F.when(F.col("loyalty_member"), F.floor(_milli() / 100)).otherwise(0)
    baskets = store.groupBy("purchase_id", "fuel_txn_id").agg(
        F.count("*").alias("lines"),
        F.sum(_cents("line_total")).alias("total"),
        F.min(_cents("basket_total")).alias("lowest"),
        F.max(_cents("basket_total")).alias("highest"),
        F.min("store_ts").alias("entry"),
        F.first("customer_id").alias("shopper"),
        rules["store_purchases"]["line total"].alias("broken_lines"),
    )
    entries = baskets.join(
        fuel.select("fuel_txn_id", "customer_id", "transaction_ts"), "fuel_txn_id", "left"
    )
    gap = F.timestamp_diff("MINUTE", F.col("transaction_ts"), F.col("entry"))
    of_visits = {
        "customer exists": _violations(F.col("loyalty_member").isNull()),
        **rules["fuel_transactions"],
        "loyalty points": _violations(F.col("loyalty_points_earned") != points),
    }
    of_baskets = {
        "line total": F.sum("broken_lines"),
        "basket total": _violations(
            (F.col("total") != F.col("lowest")) | (F.col("total") != F.col("highest"))
        ),
        "lines per basket": _violations(~F.col("lines").between(1, MAX_ITEMS)),
        "fuel visit exists": _violations(F.col("customer_id").isNull()),
        "same customer": _violations(F.col("customer_id") != F.col("shopper")),
        "minutes to store": _violations(~gap.between(*GAP_MINUTES)),
    }
    return _by_rule(visits, of_visits).unionByName(_by_rule(entries, of_baskets))


def conversion_summary(
    customers: DataFrame, fuel: DataFrame, store: DataFrame, sizes: dict[str, int] | None = None
) -> DataFrame:
    """One row: table sizes, distinct pumpers and shoppers and their ratio in percent.

    ``sizes`` of the three tables, where they were counted as they were written, save counting them again.
    """
    if sizes is not None:
        known = dict(zip(("customers", "fuel_transactions", "store_line_items"), sizes.values(), strict=True))
        return customer_conversion(fuel, store).select(*[F.lit(n).cast("bigint").alias(c) for c, n in known.items()], "*")
    counted = [
        customers.agg(F.count("*").alias("customers")),
        fuel.agg(F.count("*").alias("fuel_transactions")),
        store.agg(F.count("*").alias("store_line_items")),
        customer_conversion(fuel, store),
    ]
    rows = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), counted)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
