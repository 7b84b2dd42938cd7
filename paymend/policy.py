"""Thresholds and prices of the recovery policy, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass

# The closed vocabularies of the data model.
CATEGORIES = (
    "GATEWAY_DOWN",
    "USER_CANCELLED",
    "NETWORK_TIMEOUT",
    "INSUFFICIENT_FUNDS",
    "INVALID_DETAILS",
    "BANK_DECLINE",
    "UNKNOWN",
)
ACTIONS = (
    "RETRY_PAYMENT",
    "SEND_REMINDER",
    "OFFER_EMI",
    "OFFER_ALTERNATE_UPI",
    "NOTIFY_SUPPORT",
    "NO_ACTION",
)
STATUSES = (
    "FAILED",
    "ML_SCORED",
    "LOW_PRIORITY_SKIP",
    "AGENT_EVALUATED",
    "PENDING_APPROVAL",
    "ACTION_TRIGGERED",
    "RECOVERING",
    "RECOVERED",
    "EXPIRED",
    "REJECTED",
    "EV_BYPASSED",
)
CHANNELS = ("whatsapp", "sms", "email", "notify_support")
METHODS = ("card_retry", "upi", "netbanking", "wallet")
RETRY_WINDOWS_MIN = (5, 15, 30, 60, 180, 360)
ARMS = ("control", "variant")


@dataclass(frozen=True)
class Policy:
    """Every tunable of a decision run. Decimals are kept as text."""

    max_attempts: int = 2
    low_priority_below: float = 0.15
    variant_percent: int = 50
    review_amount_paise: int = 5_000_000
    review_discount_above: float = 10.0
    review_attempts: int = 3
    review_score_low: float = 0.40
    review_score_high: float = 0.60
    max_discount: str = "15.0"
    minimum_ev: str = "0.00"
    operational_fee: str = "2.50"
    gateway_percent: str = "1.5"
    execution_mode: str = "LIVE"

    @property
    def shadow(self) -> bool:
        """Only the exact word SHADOW suppresses dispatch; anything else is live."""
        return (self.execution_mode or "").strip().upper() == "SHADOW"


DEFAULT_POLICY = Policy()
