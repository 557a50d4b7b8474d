"""Trading symbols, wallet addresses, transactions and document kinds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_col

# Common asset names and their tickers.
NAME_TO_TICKER = {
    "BITCOIN": "BTC", "ETHEREUM": "ETH", "SOLANA": "SOL", "CARDANO": "ADA", "RIPPLE": "XRP",
    "POLKADOT": "DOT", "DOGECOIN": "DOGE", "AVALANCHE": "AVAX", "BINANCE COIN": "BNB", "BINANCE": "BNB",
    "LITECOIN": "LTC", "CHAINLINK": "LINK", "POLYGON": "MATIC", "UNISWAP": "UNI", "TETHER": "USDT",
}
# Quote currencies in the order in which a symbol's ending is tested.
QUOTES = ["USD", "USDT", "USDC", "BTC", "ETH"]
# 4-byte selectors of frequent contract calls.
SELECTORS = {
    "0xa9059cbb": "erc20_transfer",
    "0x095ea7b3": "erc20_approve",
    "0x2e1a7d4d": "withdraw",
    "0x3593564c": "execute_trade",
}
# Internal document kinds and the kinds under which they are stored.
STORED_TYPE = {
    "whitepaper": "whitepaper",
    "agreement": "project_documentation",
    "regulation": "regulatory_filing",
    "legal_case": "regulatory_filing",
    "financial_analysis": "due_diligence_report",
    "risk_assessment": "due_diligence_report",
    "other": "project_documentation",
}
# Words in a file name that decide the document kind, in order.
NAME_RULES = [
    ("whitepaper", ["whitepaper", "white-paper"]),
    ("agreement", ["agreement", "contract"]),
    ("regulation", ["regulation", "guidance"]),
    ("legal_case", ["case", "court", "v."]),
    ("financial_analysis", ["analysis", "report"]),
    ("risk_assessment", ["risk", "assessment"]),
]


def lookup(value: Column, table: Mapping[str, str], default: Column) -> Column:
    """Constant map lookup inside the plan."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, value), default)


def norm_symbol(value: str | Column, style: str = "pair", quote: str = "USDT") -> Column:
    """Ticker of a name or pair: ``base`` (BTC), ``pair`` (BTCUSDT) or ``storage`` (BTC_USDT)."""
    text = F.upper(F.trim(as_col(value)))
    text = F.regexp_replace(lookup(text, NAME_TO_TICKER, text), r"[^A-Z0-9]", "")
    base = F.regexp_replace(text, r"(?<=.)(USDT|USDC|USD)$", "")
    if style == "base":
        return base
    return F.concat(base, F.lit("_" + quote if style == "storage" else quote))


def split_pair(value: str | Column) -> Column:
    """Struct ``(base, quote)``; a known ending, else the last three letters, else USD."""
    text = F.upper(F.trim(as_col(value)))
    length = F.length(text)
    base = F.when(length > 3, text.substr(F.lit(1), length - 3)).otherwise(text)
    quote = F.when(length > 3, text.substr(length - 2, F.lit(3))).otherwise(F.lit("USD"))
    for q in reversed(QUOTES):
        hit = text.endswith(q)
        base = F.when(hit, text.substr(F.lit(1), length - len(q))).otherwise(base)
        quote = F.when(hit, F.lit(q)).otherwise(quote)
    return F.struct(base.alias("base"), quote.alias("quote"))


def is_eth_address(value: str | Column) -> Column:
    return as_col(value).rlike(r"^0x[a-fA-F0-9]{40}$")


def norm_address(value: str | Column) -> Column:
    """Lower-case, trimmed address; empty text for null."""
    return F.coalesce(F.lower(F.trim(as_col(value))), F.lit(""))


def short_address(value: str | Column, head: int = 6, tail: int = 4) -> Column:
    """``0x1234...abcd``; short texts stay whole."""
    text = as_col(value)
    cut = F.concat(text.substr(1, head), F.lit("..."), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= head + tail, text).otherwise(cut)


def tx_category(data: str | Column) -> Column:
    """Kind of a transaction from its input data."""
    text = F.coalesce(as_col(data), F.lit("0x"))
    out = F.when(text == "0x", F.lit("transfer"))
    for selector, kind in SELECTORS.items():
        out = out.when(text.startswith(selector), F.lit(kind))
    return out.otherwise(F.lit("contract_interaction"))


def doc_type_from_name(name: str | Column) -> Column:
    """Document kind a file name gives away, else null."""
    text = F.lower(as_col(name))
    out = F.when(F.lit(False), F.lit(""))
    for kind, words in NAME_RULES:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word)
        out = out.when(hit, F.lit(kind))
    return out


def map_type(kind: str | Column) -> Column:
    """Stored document kind of an internal one."""
    return lookup(F.lower(as_col(kind)), STORED_TYPE, F.lit("project_documentation"))
