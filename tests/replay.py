"""Plain Python replay of the feature definitions, used as the model in tests."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

DAY = 86_400_000


def _round(value, digits):
    return float(value.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def replay(rows, home="SE", window_days=30):
    """``rows``: dicts with id, customer, merchant, amount, country, ms. Returns features per id."""
    out = {}
    history = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ms"], r["id"])):
        past = history[r["customer"]]
        day = r["ms"] // DAY
        counts, first, last = defaultdict(int), {}, {}
        for p in past:
            if day - (window_days - 1) <= p["ms"] // DAY <= day:
                m = p["merchant"]
                counts[m] += 1
                first[m] = min(first.get(m, p["ms"]), p["ms"])
                last[m] = max(last.get(m, p["ms"]), p["ms"])
        ranked = sorted(counts, key=lambda m: (-counts[m], m))
        mine, total = counts.get(r["merchant"], 0), sum(counts.values())

        def since(moment):
            return _round(Decimal(max(0, r["ms"] - moment)) / Decimal(DAY), 6)

        past.append(r)

        def window(width):
            return [p for p in past if r["ms"] - width <= p["ms"] <= r["ms"]]

        day_rows, week = window(DAY), window(7 * DAY)
        cents = [Decimal(p["amount"]).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) for p in week]
        out[r["id"]] = {
            "customer_transaction_count_1h": len(window(DAY // 24)),
            "customer_transaction_count_24h": len(day_rows),
            "customer_total_amount_24h": float(
                sum(Decimal(p["amount"]).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP) for p in day_rows)
            ),
            "customer_avg_amount_7d": _round(sum(cents) / len(cents), 2),
            "customer_max_amount_7d": float(max(cents)),
            "customer_distinct_merchants_24h": len({p["merchant"] for p in day_rows}),
            "customer_cross_border_count_7d": sum(p["country"].upper() != home for p in week),
            "current_merchant_visit_count_30d": mine,
            "current_merchant_visit_share_30d": _round(Decimal(mine) / Decimal(total), 6) if total else 0.0,
            "current_merchant_rank_30d": ranked.index(r["merchant"]) + 1 if mine else 0,
            "is_current_merchant_top_visited_30d": int(bool(mine) and ranked[0] == r["merchant"]),
            "days_since_first_seen_current_merchant": since(first[r["merchant"]]) if mine else -1.0,
            "days_since_last_seen_current_merchant": since(last[r["merchant"]]) if mine else -1.0,
            "customer_distinct_merchants_30d": len(counts),
            "is_new_merchant_for_customer": int(not mine),
            "top_visited_merchant_id_30d": ranked[0] if ranked else "",
        }
    return out
