"""Invoices in texts, their line items, and checks of structured values against a schema."""

from __future__ import annotations

import re

from lettermill.functions.text import money_minor

# What speaks for an invoice or a receipt, and by how much.
INVOICE = {"invoice": 3, "rechnung": 3, "facture": 3, "factura": 3, "due date": 2, "amount due": 2, "total": 1, "vat": 1, "iban": 1}
RECEIPT = {"receipt": 3, "quittung": 3, "paid": 2, "thank you for your purchase": 2, "total": 1}
LABELS = {"total": r"(?:grand )?total|amount due|gesamtbetrag", "subtotal": r"sub-?total|net", "tax": r"(?:vat|tax|mwst)", "number": r"invoice (?:no|number|#)|rechnungsnummer", "date": r"(?:invoice )?date|datum"}
HEADERS = {"description": {"description", "item", "product", "position"}, "quantity": {"qty", "quantity", "menge", "units"}, "unit": {"unit price", "price", "preis"}, "amount": {"amount", "total", "betrag", "sum"}}


def detect(text: str, filename: str = "", least: int = 5) -> str | None:
    """invoice, receipt or None; a receipt only if it has more for it. Nothing without an amount."""
    low = text.lower()
    if not re.search(r"[€$£]\s?\d|\d[.,]\d{2}\b", text):
        return None
    score = lambda words: sum(w for k, w in words.items() if k in low) + 3 * any(k in filename.lower() for k in words if len(k) > 6)
    a, b = score(INVOICE), score(RECEIPT)
    if max(a, b) < least:
        return None
    return "receipt" if b > a else "invoice"


def parse(text: str) -> dict:
    """Values by label, one a line; consistent says whether subtotal and tax make the total."""
    out: dict = {}
    for line in text.splitlines():
        for name, label in LABELS.items():
            m = re.match(rf"(?i)\s*(?:{label})\b[\s.:#]*(.+)$", line)
            if m and name not in out:
                if name in ("number", "date"):
                    out[name] = m[1].strip()
                elif (value := money_minor(m[1])) is not None:
                    out[name], out["currency"] = value[0], out.get("currency") or value[1]
                break
    parts = [out.get(k) for k in ("subtotal", "tax", "total")]
    out["consistent"] = None if None in parts else parts[0] + parts[1] == parts[2]
    return out


def line_items(header: list[str], rows: list[list[str]]) -> list[dict]:
    """Rows of a table as items, by what its header calls the columns."""
    at = {k: i for k, names in HEADERS.items() for i, h in enumerate(header) if h.strip().lower() in names}
    return [{k: row[i].strip() if i < len(row) else None for k, i in at.items()} for row in rows] if "description" in at else []


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value by type, required, properties, items, enum, minimum, maximum and pattern."""
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    want = schema.get("type")
    if want and (not isinstance(value, kinds[want]) or isinstance(value, bool) and want in ("number", "integer")):
        return [f"{at}: not {want}"]
    found = [f"{at}: not one of {schema['enum']}"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, s in schema.get("properties", {}).items():
            if k in value:
                found += validate(value[k], s, f"{at}.{k}")
    elif isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += validate(v, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        found.append(f"{at}: does not match")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at}: out of range")
    return found
