"""Message templates (our own wording) and their rendering per channel."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paymend.policy import CATEGORIES

_CAUSE = {
    "GATEWAY_DOWN": "the payment gateway was down for a moment",
    "USER_CANCELLED": "checkout was closed before it finished",
    "NETWORK_TIMEOUT": "the network timed out",
    "INSUFFICIENT_FUNDS": "the account balance was too low",
    "INVALID_DETAILS": "some card details did not match",
    "BANK_DECLINE": "the bank declined the charge",
    "UNKNOWN": "the payment failed for an unclear reason",
}
_REMEDY = {
    "GATEWAY_DOWN": "a retry should pass now",
    "USER_CANCELLED": "your basket is saved as a reminder",
    "NETWORK_TIMEOUT": "a second try usually works",
    "INSUFFICIENT_FUNDS": "you may split it into an emi plan",
    "INVALID_DETAILS": "please check the details and try again",
    "BANK_DECLINE": "another upi or bank account may work",
    "UNKNOWN": "our support desk can help",
}
_OPENING = {"whatsapp": "Hi {name},", "email": "Dear {name},"}
_CLOSING = {
    "small": "finish {amount} rupees in one tap: {link}",
    "medium": "complete the amount of {amount} rupees securely here: {link}",
    "large": "for this large order of {amount} rupees our team kept the price, continue at {link}",
}


def template_rows() -> list[tuple]:
    """(id, rank, category, channel, band, outcome, rate, text): 7 x 2 x 3 rows from the phrases above."""
    rows = []
    for c, category in enumerate(CATEGORIES):
        for h, channel in enumerate(_OPENING):
            for b, band in enumerate(_CLOSING):
                text = " ".join(
                    (_OPENING[channel], _CAUSE[category] + ";", _REMEDY[category] + ".", _CLOSING[band])
                )
                rate = round(0.78 - 0.06 * c - 0.04 * h - 0.03 * b, 2)
                outcome = "recovered" if rate >= 0.45 else "partial"
                rank = len(rows)
                rows.append((f"P{rank + 1:03d}", rank, category, channel, band, outcome, rate, text))
    return rows


# Message bodies by channel.
BODIES = {
    "whatsapp": "Hello {name}, your payment of ₹{amount} to {merchant} did not go through ({reason}). Pay here within 1 hour: {link}",
    "sms": "{merchant}: payment ₹{amount} failed ({reason}). Pay: {link}. Reply STOP to end.",
    "email": "Dear {name}, the payment of ₹{amount} to {merchant} failed. Reason: {reason}. Pay here: {link}. The link is valid for 1 hour.",
}
SMS_REASON_CHARS = 30


def whole_rupees(amount_paise: Column) -> Column:
    """Rupees without digits after the point; an exact half goes to the even neighbour."""
    return F.bround(amount_paise.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)"), 0).cast(
        "decimal(18,0)"
    ).cast("string")


def fill(body: Column, **values: Column) -> Column:
    """Put the given columns into ``{name}`` slots."""
    for slot, value in values.items():
        body = F.replace(body, F.lit("{" + slot + "}"), F.coalesce(value, F.lit("")))
    return body


def render(
    channel: Column, amount_paise: Column, merchant: Column, reason: Column, link: Column, name: Column
) -> Column:
    """Body for the row's channel; an SMS carries at most 30 letters of the reason."""
    short = F.when(channel == "sms", F.substring(reason, 1, SMS_REASON_CHARS)).otherwise(reason)
    slots = {
        "name": name,
        "amount": whole_rupees(amount_paise),
        "merchant": merchant,
        "reason": short,
        "link": link,
    }
    out = F.when(channel == "whatsapp", fill(F.lit(BODIES["whatsapp"]), **slots))
    for key in ("sms", "email"):
        out = out.when(channel == key, fill(F.lit(BODIES[key]), **slots))
    return out
