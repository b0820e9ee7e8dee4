"""Typed settings and brand dimensions.

Everything here is a small, fixed dimension or a threshold.  Values that
decide results (word lists, cutoffs, message formats) are stated as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Intent:
    id: str
    name: str
    description: str
    keywords: tuple[str, ...]
    auto_handle_eligible: bool = True


@dataclass(frozen=True)
class Persona:
    tone: str
    greeting: str
    signoff: str
    dm_action_url: str
    escalation_message: str


@dataclass(frozen=True)
class Brand:
    id: str
    name: str
    display_name: str
    domain: str
    intents: tuple[Intent, ...]
    persona: Persona
    language: str = "en"
    filter_non_english: bool = True
    sampling: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EscalationSettings:
    confidence_min: float = 0.70
    sentiment_negative_max: float = -0.40
    max_customer_turns: int = 3
    rag_similarity_min: float = 0.65


@dataclass(frozen=True)
class RetrievalSettings:
    dense_weight: float = 0.6
    bm25_weight: float = 0.4
    rrf_k: int = 60
    candidate_pool: int = 15
    fused_k: int = 6
    context_k: int = 3
    rerank_floor: float = -10.0


@dataclass(frozen=True)
class CacheSettings:
    similarity_threshold: float = 0.97
    min_confidence: float = 0.90
    max_entries: int | None = None  # no limit


@dataclass(frozen=True)
class CostSettings:
    false_auto_handle: float = 10.0
    false_escalation: float = 1.5


# --------------------------------------------------------------------------
# Keyword lists, in list order (the order decides the reason).
# --------------------------------------------------------------------------
RISK_KEYWORDS = (
    "lawyer", "attorney", "sue", "legal", "police", "court",
    "fraud", "scam", "unauthorized", "hacked", "stolen",
    "danger", "emergency", "assault", "harassment", "injury",
)
GOLDEN_KEYWORDS = (
    "lawyer", "sue", "locked", "hacked", "police", "fraud",
    "unauthorized", "scam", "danger",
)
BASELINE_KEYWORDS = (
    "lawyer", "sue", "legal", "locked", "hacked", "police",
    "fraud", "unauthorized", "scam", "danger", "manager", "supervisor",
)

# Offline intent rules, first group with a hit wins.
INTENT_RULES = (
    ("order_tracking_delivery", ("track", "where", "package", "delivery", "late", "order")),
    ("refund_return_cancellation", ("refund", "return", "cancel", "damaged", "broken")),
    ("prime_subscription_billing", ("prime", "charged", "fee", "subscription", "bill")),
    ("account_security_access", ("locked", "password", "otp", "login", "hacked", "security")),
    ("digital_services_devices", ("kindle", "fire", "alexa", "echo", "video", "device")),
    ("ios_macos_software_update", ("ios", "update", "battery", "drain", "wifi")),
    ("trip_fare_billing_dispute", ("fare", "overcharge", "cancellation fee", "toll")),
    ("lost_item_in_vehicle", ("left", "lost", "wallet", "phone in car", "driver")),
)
DEFAULT_INTENT = "general_feedback_complaint"
RULE_CONFIDENCE = 0.85

# Static exemplars used when no labelled pool is given.
STATIC_EXEMPLARS = (
    ("Where is my package? It was supposed to arrive yesterday.", "order_tracking_delivery"),
    ("I want to return this broken item and get a refund.", "refund_return_cancellation"),
    ("My account is locked and I cannot reset my password.", "account_security_access"),
)

# Canned replies.
TRIVIAL_REPLY = (
    "Thank you for contacting customer support. We have received your inquiry and are "
    "looking into it. Please check our online help center for further details."
)
BASELINE_REPLY = "Please contact support with your order details."
OFFLINE_DRAFT = (
    "Hello! We are here to help resolve your issue. Please send us a direct message with "
    "your details so our team can assist right away."
)

# English function words removed before tf-idf (a parameter of every caller).
STOP_WORDS = tuple(
    """
    about above after again against all am an and any are as at be because been before
    being below between both but by can cannot could did do does doing down during each few
    for from further had has have having he her here hers herself him himself his how if in
    into is it its itself just me more most my myself no nor not now of off on once only or
    other our ours ourselves out over own same she should so some such than that the their
    theirs them themselves then there these they this those through to too under until up
    very was we were what when where which while who whom why will with would you your yours
    yourself yourselves
    """.split()
)

# --------------------------------------------------------------------------
# Brand dimensions.
# --------------------------------------------------------------------------
AMAZONHELP = Brand(
    id="amazonhelp",
    name="AmazonHelp",
    display_name="Amazon Customer Support",
    domain="E-Commerce & Digital Services",
    intents=(
        Intent(
            "order_tracking_delivery",
            "Order Tracking & Delivery Status",
            "Inquiries about late shipments, where is my order (WISMO), estimated arrival dates, "
            "missing delivery packages, carrier delays, or locker pickups.",
            ("track", "where", "package", "order", "delivery", "carrier", "late", "arrived",
             "delay", "ship", "locker", "driver"),
        ),
        Intent(
            "refund_return_cancellation",
            "Returns, Refunds & Order Cancellation",
            "Requests to return received items, issue full/partial refunds, cancel placed orders, "
            "return drop-off locations, or replace damaged goods.",
            ("refund", "return", "cancel", "money back", "replace", "damaged", "broken",
             "dropoff", "return label", "reimbursement"),
        ),
        Intent(
            "prime_subscription_billing",
            "Prime Membership & Billing Inquiries",
            "Questions regarding Prime trial charges, membership cancellations, annual renew fees, "
            "unrecognized credit card charges, or invoice discrepancies.",
            ("prime", "charged", "fee", "membership", "subscription", "annual", "renew", "bill",
             "payment method", "unauthorized charge"),
        ),
        Intent(
            "account_security_access",
            "Account Access, OTP & Security",
            "Locked accounts, password reset failures, two-factor OTP authentication issues, "
            "suspicious login alerts, hacked accounts.",
            ("locked", "password", "otp", "login", "hacked", "security", "unauthorized", "2fa",
             "verification", "access"),
            auto_handle_eligible=False,
        ),
        Intent(
            "digital_services_devices",
            "Kindle, Fire TV, Echo & Digital Content",
            "Troubleshooting Kindle e-readers, Fire TV sticks, Alexa/Echo smart speakers, Prime "
            "Video playback errors, or Amazon Music sync issues.",
            ("kindle", "fire tv", "alexa", "echo", "prime video", "music", "device", "app",
             "stream", "ebook"),
        ),
        Intent(
            "seller_product_inquiry",
            "Third-Party Sellers, Stock & Product Details",
            "Inquiries regarding Marketplace third-party sellers, product authenticity, warranties, "
            "out-of-stock items, or price matching.",
            ("seller", "third party", "marketplace", "stock", "warranty", "authentic",
             "counterfeit", "price match", "item details"),
        ),
        Intent(
            "general_feedback_complaint",
            "General Grievance, CS Escalation & Feedback",
            "Customer rage, severe service dissatisfaction, demands to speak with a supervisor, "
            "legal/regulatory threats, or positive agent praise.",
            ("worst", "terrible", "lawyer", "sue", "manager", "supervisor", "unacceptable",
             "scam", "disgusted", "great job", "thanks"),
            auto_handle_eligible=False,
        ),
    ),
    persona=Persona(
        tone="Empathetic, clear, concise, professional and action-oriented",
        greeting="Hello! We'd love to help.",
        signoff="^Agent",
        dm_action_url="https://amzn.to/help",
        escalation_message="I understand your concern and I want to make sure this gets resolved "
        "for you immediately. I am connecting you with an Amazon Customer Specialist who has "
        "access to your full account details.",
    ),
    sampling={"max_train_threads": 25000, "golden_set_size": 200},
)

APPLESUPPORT = Brand(
    id="applesupport",
    name="AppleSupport",
    display_name="Apple Support",
    domain="Consumer Electronics & OS Ecosystem",
    intents=(
        Intent(
            "ios_macos_software_update",
            "iOS/macOS Updates & Software Glitches",
            "Issues installing iOS/macOS updates, app crashes, freezing screens, battery drain "
            "after updates, or Bluetooth/WiFi connectivity.",
            ("ios", "update", "macos", "battery", "drain", "crash", "freeze", "wifi",
             "bluetooth", "bug", "reboot"),
        ),
        Intent(
            "apple_id_icloud_security",
            "Apple ID, iCloud Storage & Lockout",
            "Forgotten Apple ID password, Activation Lock, two-factor authentication codes, "
            "iCloud storage full, or account recovery.",
            ("apple id", "icloud", "activation lock", "passcode", "password", "locked",
             "storage", "2fa", "recovery", "disabled"),
            auto_handle_eligible=False,
        ),
        Intent(
            "hardware_repair_battery_screen",
            "Hardware Repairs, Genius Bar & Screen/Battery Replacement",
            "Broken screens, swollen batteries, water damage, AppleCare warranty coverage claims, "
            "Genius Bar appointment bookings.",
            ("repair", "screen", "cracked", "battery replacement", "genius bar", "applecare",
             "appointment", "hardware", "water damage"),
        ),
        Intent(
            "subscriptions_billing_appstore",
            "App Store Purchases, Subscriptions & Refunds",
            "Accidental in-app purchases, recurring subscription cancellations, Apple Music "
            "charges, or request a refund on reportaproblem.apple.com.",
            ("subscription", "app store", "purchase", "charged", "refund", "in-app",
             "apple music", "receipt", "reportaproblem"),
        ),
        Intent(
            "device_setup_trade_in",
            "New Device Setup, Data Migration & Trade-In",
            "Transferring data from old iPhone to new iPhone, eSIM activation, Trade-in kit "
            "inquiries, delivery status of new hardware orders.",
            ("transfer", "setup", "trade in", "new iphone", "esim", "backup", "restore",
             "order status", "delivery"),
        ),
        Intent(
            "general_feedback_escalation",
            "Severe Grievance, Store Feedback & Escalation",
            "Frustrated customer complaints, negative retail Apple Store experiences, supervisor "
            "escalation requests.",
            ("terrible", "worst", "unacceptable", "manager", "store experience", "supervisor",
             "complaint", "refuse"),
            auto_handle_eligible=False,
        ),
    ),
    persona=Persona(
        tone="Calm, polite, technically knowledgeable, precise, and supportive",
        greeting="We're here to help.",
        signoff="",
        dm_action_url="https://apple.co/support",
        escalation_message="We want to make sure your Apple device is working properly. Let's get "
        "you in touch with an Apple Specialist for one-on-one troubleshooting.",
    ),
    sampling={"max_train_threads": 15000, "golden_set_size": 50},
)

UBER_SUPPORT = Brand(
    id="uber_support",
    name="Uber_Support",
    display_name="Uber Support",
    domain="Ride-Hailing, Delivery & Logistics",
    intents=(
        Intent(
            "trip_fare_billing_dispute",
            "Fare Review, Overcharge & Toll Disputes",
            "Disputes regarding unexpected surge pricing, route inefficiency, incorrect toll "
            "charges, cleaning fees, or cancellation fee refunds.",
            ("fare", "charged", "overcharge", "cancellation fee", "toll", "route", "refund",
             "receipt", "surge", "expensive"),
        ),
        Intent(
            "lost_item_in_vehicle",
            "Lost Item in Vehicle / Driver Contact",
            "Customer left phone, wallet, keys, or baggage in an Uber vehicle and needs help "
            "contacting driver.",
            ("left", "lost", "wallet", "phone", "keys", "bag", "driver", "vehicle", "forgot",
             "back seat"),
        ),
        Intent(
            "driver_behavior_safety_incident",
            "Driver Conduct, Safety & Vehicle Quality",
            "Reports of dangerous driving, rude driver conduct, refusal of destination, vehicle "
            "not matching app details, or physical safety incidents.",
            ("unsafe", "rude", "dangerous", "accident", "police", "harassment", "car smell",
             "reckless", "threat", "refused"),
            auto_handle_eligible=False,
        ),
        Intent(
            "eats_order_missing_damaged",
            "Uber Eats Missing Items, Late Food & Wrong Order",
            "Cold food, missing items from restaurant bag, order delivered to wrong address, food "
            "spills.",
            ("food", "eats", "missing", "cold", "spilled", "wrong item", "restaurant", "hungry",
             "delivery"),
        ),
        Intent(
            "account_promo_pass_inquiry",
            "Uber One Membership, Promo Codes & Account Access",
            "Promo code not applying, Uber One subscription renewals, phone number change, or "
            "disabled rider accounts.",
            ("promo", "discount", "code", "uber one", "pass", "phone number", "account",
             "login", "membership"),
        ),
        Intent(
            "general_feedback_escalation",
            "Service Outrage & Legal/Executive Escalation",
            "Extreme rider outrage, threats of legal action, BBB complaints, repeated unhelpful "
            "responses.",
            ("worst", "lawyer", "scam", "disgusting", "never using again", "manager",
             "unacceptable", "supervisor"),
            auto_handle_eligible=False,
        ),
    ),
    persona=Persona(
        tone="Prompt, empathetic, reassuring, direct and safety-conscious",
        greeting="Hi there,",
        signoff="",
        dm_action_url="https://help.uber.com",
        escalation_message="Your safety and experience are our top priorities. We are escalating "
        "this to our specialized Priority Support Team to review right away.",
    ),
    sampling={"max_train_threads": 15000, "golden_set_size": 50},
)

BRANDS = {b.id: b for b in (AMAZONHELP, APPLESUPPORT, UBER_SUPPORT)}


def brand_config(name: str) -> Brand:
    """Look a brand up by name, ignoring case."""
    try:
        return BRANDS[name.lower()]
    except KeyError:
        raise KeyError(f"unknown brand: {name}") from None
