"""Tender documents: regions by heading, and tables of prices and forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.rules import header_part

# fixed values
TECHNICAL = (
    r"(?i)\b(?:technical\s+specification|statement\s+of\s+requirements?|scope\s+of\s+work|technical\s+requirements?|functional\s+requirements?"
    r"|specification\s+of\s+supply|supply\s+and\s+delivery|scope\s+of\s+supply|equipment\s+specification|system\s+requirements?"
    r"|performance\s+requirements?|technical\s+data|service\s+specification|work\s+specification|qualification\s+tests?|type\s+tests?"
    r"|routine\s+tests?|acceptance\s+tests?|witness\s+tests?|factory\s+acceptance|site\s+acceptance"
    r"|tests?\s+(?:procedures?|methods?|requirements?|conditions?|plans?|specifications?)|testing\s+(?:requirements?|procedures?|methods?|specifications?))"
    r"|^(?:技术规范|技术规格|技术参数|技术要求|功能要求|供货范围|供货清单|设备规格|系统要求|性能要求|技术数据|服务要求|工作范围|型式试验|出厂试验|例行试验|验收试验|测试方法|试验方法)"
)
INSTRUCTIONS = (
    r"(?i)\b(?:instructions?\s+to\s+bidders?|bidding\s+instructions?|instructions?\s+for\s+tender|tender\s+instructions?|bid\s+submission|submission\s+of\s+tender"
    r"|qualification\s+(?:requirements?|conditions?|criteria|of\s+(?:the\s+)?(?:bidder|tenderer|contractor|supplier|manufacturer))"
    r"|qualifying\s+(?:conditions?|requirements?|criteria|bidder)|pre\s*qualification|prequalification"
    r"|eligibility\s+(?:criteria|requirements?|of\s+(?:bidder|tenderer))|eligible\s+bidder"
    r"|evaluation\s+(?:criteria|methodology|method|process|procedure|committee|report|matrix|sheet)"
    r"|evaluation\s+of\s+(?:bid|bids|tender|tenders|proposal|proposals|offer|offers)|(?:bid|tender)\s+evaluation|evaluation\s+and\s+award"
    r"|assessment\s+(?:criteria|methodology|matrix|sheet)|assessment\s+of\s+(?:bid|bids|tender|proposal|proposals|offer|bidder|tenderer)|(?:bid|tender)\s+assessment"
    r"|scoring\s+(?:criteria|sheet|matrix|methodology|method)|award\s+criteria|selection\s+criteria|general\s+conditions|conditions\s+of\s+tender|tender\s+conditions"
    r"|contract\s+conditions|terms\s+and\s+conditions|commercial\s+terms|price\s+schedule|bill\s+of\s+quantities|boq|form\s+of\s+tender|tender\s+form|bid\s+form"
    r"|declaration|signatory|bank\s+guarantee|performance\s+bond|tender\s+validity|validity\s+period|closing\s+date|opening\s+of\s+tender|bid\s+opening"
    r"|opening\s+of\s+(?:the\s+)?bids?|tax\s+clearance|bid\s+security|bid\s+bond|submission\s+deadline|procurement|purchasing|vendor\s+registration)"
    r"|^(?:投标须知|投标人须知|资格要求|评审办法|评标办法|合同条款|商务条款|价格表|报价表|投标函|法定代表人|授权书|银行保函|履约保函|开标|评标|定标|采购公告|招标公告|资格预审)"
)
COMMERCIAL = (
    r"(?i)\b(?:commercial\s+schedule|commercial\s+proposal|price\s+schedule|pricing\s+schedule|annexure\s+[a-z]\s*[-:]\s*commercial|schedule\s+of\s+prices"
    r"|bill\s+of\s+quantities|contract\s+data|agreement|form\s+of\s+agreement|appendix\s+\w+\s+commercial)|^(?:商务附件|商务部分|价格部分|报价部分|合同数据|协议|附录.*商务)"
)
PREFACE = (
    r"(?i)\b(?:preface|foreword|introduction|overview|general\s+information|background|purpose|objective|intent|scope\s+of\s+document|document\s+scope)"
    r"|^(?:前言|序言|引言|简介|概述|总则|总说明|背景|目的|范围)|^\s*1\.\s*(?:introduction|overview|scope|general)\s*$"
)
COMMERCIAL_HEADERS = (
    "price", "prices", "pricing", "amount", "amounts", "total", "totals", "sum", "subtotal", "vat", "tax", "currency", "currencies", "usd", "zar", "euro",
    "euros", "gbp", "yen", "rand", "dollar", "dollars", "quantity", "quantities", "qty", "unit price", "unit prices", "unit cost", "unit costs", "cost", "costs",
    "bid price", "bid amount", "tender price", "contract price", "lump sum", "signature", "signatures", "signed", "sign", "date", "dates", "place",
    "bidder", "bidders", "vendor", "vendors", "supplier", "suppliers", "contractor", "contractors", "company", "companies", "firm", "firms", "manufacturer",
    "authorised signatory", "authorized signatory", "witness", "witnesses", "page", "pages", "item no", "item number", "line item", "line no", "s/no",
    "serial no", "serial number",
)
TECHNICAL_HEADERS = (
    "requirement", "requirements", "technical", "characteristic", "characteristics", "value", "values", "specification", "specifications", "min", "max", "minimum",
    "maximum", "limit", "rating", "nominal", "tolerance", "range", "unit", "parameter", "test", "tests", "standard", "standards", "clause", "clauses", "frequency",
    "voltage", "current", "power", "temperature", "humidity", "accuracy", "class", "protection", "ip", "obis", "cosem", "dlms", "sts", "plc", "rf", "dcu",
)
TITLE_WORDS = ("price", "pricing", "bid form", "tender form", "qualification", "declaration", "signature")
PRICE = r"(?i)(?:^|\s)\d[\d,\s]*(?:\.\d{1,2})?\s*(?:USD|EUR|GBP|ZAR|Rand|\$|€|£)|(?:^|\s)(?:USD|EUR|GBP|ZAR|Rand|\$|€|£)\s*\d[\d,\s]*(?:\.\d{1,2})?"
QUANTITY = r"(?i)\b\d[\d,\s]*\s*(?:pcs|pieces|sets|units|ea|nos|no\.|m\s*\.\s*|km|kg|tons?|meters?|metres?)\b"
MODAL = r"(?i)\b(?:shall|must|should|required|mandatory)\b|(?:应当|必须|不得|应满足|应支持|须符合)"


def _v(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def plain_title(text: Column) -> Column:
    """Lower case, signs to blanks, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(_v(text), r"[^\p{L}\p{N}_\s]", " ")), r"\s+", " "))


def region_of_heading(text: Column) -> Column:
    """tender_technical, tender_instructions, tender_commercial or tender_preface, the first that fits; else null."""
    t = plain_title(text)
    return F.when(t.rlike(TECHNICAL), "tender_technical").when(t.rlike(INSTRUCTIONS), "tender_instructions").when(t.rlike(COMMERCIAL), "tender_commercial").when(t.rlike(PREFACE), "tender_preface")


def _names(headers: Column, words: tuple[str, ...]) -> Column:
    """Whether a header holds one of the words."""
    def one(h: Column) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(header_part(h), F.lit(word))
        return hit

    return F.exists(headers, one)


def is_commercial_table(headers: Column, cells: Column, title: Column) -> Column:
    """Whether a table, all its data cells in one array, holds prices, quantities or signatures instead of technical values."""
    count = lambda pattern: F.size(F.filter(cells, lambda c: _v(c).rlike(pattern)))
    named, price, quantity = _names(headers, COMMERCIAL_HEADERS), count(PRICE), count(QUANTITY)
    filled = F.size(F.filter(cells, lambda c: F.trim(_v(c)) != ""))
    titled = F.lit(False)
    for word in TITLE_WORDS:
        titled = titled | F.contains(header_part(title), F.lit(word))
    signal = named | (price >= 2) | (quantity >= 3) | titled
    enough = named | ((price + quantity) / filled >= 0.15)
    return F.coalesce((F.size(cells) > 0) & signal & (count(MODAL) == 0) & (named | ~_names(headers, TECHNICAL_HEADERS)) & (filled > 0) & enough, F.lit(False))
