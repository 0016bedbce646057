"""Patterns, aliases and word lists the results depend on.

Each list is a table of data in priority order; the logic that reads it lives elsewhere.
Patterns are case-insensitive.
"""

# Description pattern -> flow intent. (intent, direction or None, label, pattern)
FLOW_PATTERNS = [
    ("investment_out", "out", "Investment", r"\bROBINHOOD\s+SECURITIES\b"),
    ("investment_out", "out", "Investment", r"\bONLINE\s+REALTIME\s+PAYMENT\s+TO\s+ROBINHOOD\s+SECURITIES\b"),
    ("investment_out", "out", "Investment", r"\bFIDELITY\s+\d+\s+P?\s*FPRS?\b"),
    ("investment_out", "out", "Investment", r"\bVANGUARD\b"),
    ("investment_out", "out", "Investment", r"\b(SCHWAB|COINBASE|INTERACTIVE\s*BROKERS)\b"),
    ("cc_payment", "out", "CC Payment", r"\bPAYMENT\s+TO\s+CHASE\s+CARD\b"),
    ("cc_payment", "out", "CC Payment", r"\bPAYMENT\s+TO\s+BOFA\b"),
    ("cc_payment", "out", "CC Payment", r"\bROBINHOOD\s+CARD\s+PAYMENT\b"),
    ("cc_payment", "out", "CC Payment", r"\bDISCOVER\s+E-?PAYMENT\b"),
    ("cc_payment", "out", "CC Payment", r"\bAMERICAN\s+EXPRESS\s+ACH\s+PMT\b"),
    ("cc_payment", "out", "CC Payment", r"\bBK?\s+OF\s+AMER(?:ICA)?\s+VISA\s+ONLINE\s+P(?:AY)?MT\b"),
    ("cc_payment", "out", "CC Payment", r"\bBANK\s+OF\s+AMERICA\s+PAYMENT\b"),
    ("cc_payment", "out", "CC Payment", r"\b(CHASE|CITI|CAPITAL\s*ONE)\s+AUTOPAY\b"),
    ("cc_payment", "in", "CC Payment (received)", r"\bPAYMENT\s*-?\s*THANK\s*YOU\b"),
    ("transfer_self", None, "Transfer", r"\bKITSAP\s+CU\s+TRANSFER\b"),
    ("transfer_self", None, "Transfer", r"\b(TRANSFER|XFER)\b.*\b(TO|FROM)\b"),
    ("transfer_self", None, "Transfer", r"\bONLINE\s+BANKING\s+TRANSFER\b"),
    ("salary", "in", "Income (salary)", r"\b(PAYROLL|SALARY)\b"),
    ("salary", "in", "Income (salary)", r"\bALTERA\s+CORPORATI?\s+PAYROLL\b"),
    ("salary", "in", "Income (salary)", r"\bINFOSYS\b"),
    ("interest_charged", "out", "Fees & interest", r"\bINTEREST\s+CHARGE(\s+ON\s+(PURCHASES|CASH\s+ADVANCES))?\b"),
    ("interest_earned", "in", "Interest earned", r"\bINTEREST\s+(EARNED|PAID)\b"),
    ("interest_earned", "in", "Interest earned", r"\bDIVIDEND\b"),
    ("fees", "out", "Fees & interest", r"\b(LATE\s+FEE|OVERDRAFT\s+FEE|FOREIGN\s+TXN\s+FEE|ANNUAL\s+FEE)\b"),
    ("loan_payment", "out", "Loan/Installment", r"\bVW\s+CREDIT\b"),
    ("loan_payment", "out", "Loan/Installment", r"\bAFFIRM\.?COM\b"),
    ("loan_payment", "out", "Loan/Installment", r"\bKLARNA\b"),
    ("bill_pay", "out", "Rent/Mortgage", r"\bPENNYMAC\b"),
    ("bill_pay", "out", "Rent/Mortgage", r"\bROCKETMTG\b"),
    ("bill_pay", "out", "Rent/Mortgage", r"\bRENT\b"),
    ("bill_pay", "out", "Phone & Internet", r"\b(AT\s*&?\s*T|VERIZON|T-?MOBILE|COMCAST|XFINITY|SPECTRUM|JIO|AIRTEL)\b"),
    ("bill_pay", "out", "Insurance", r"\b(GEICO|PROGRESSIVE|STATE\s+FARM|ALLSTATE|AMERICAN\s+GEN\s+LIF|LIC|HDFC\s+LIFE)\b"),
    ("bill_pay", "out", "Subscriptions", r"\b(NETFLIX|SPOTIFY|HULU|DISNEY|AMAZON\s+PRIME|OPENAI|CHATGPT|CLAUDE|ANTHROPIC|ICLOUD|GOOGLE\s+STORAGE)\b"),
    ("refund", "in", "Refund", r"\bCARD\s+PURCHASE\s+RETURN\b"),
    ("refund", "in", "Refund", r"\bRETURN\b.*\bCREDIT\b"),
    ("cash_out", "out", "Cash", r"\b(ATM\s+WITHDRAWAL|ATM\s+CASH)\b"),
    ("cash_in", "in", "Cash", r"\b(CHECK\s+DEPOSIT|REMOTE\s+DEPOSIT|MOBILE\s+DEPOSIT)\b"),
]

# Bank-side wording of a card payment. (issuer, pattern, has last-4 group)
CARD_PAYMENT_PATTERNS = [
    ("Chase", r"Payment\s+To\s+Chase\s+Card\s+Ending\s+IN\s+(\d{3,4})", True),
    ("Discover", r"Discover\s+E-?Payment\s+(\d{3,4})\b", True),
    ("BofA", r"Bk\s+of\s+Amer\s+Visa\s+Online\s+Pmt", False),
    ("BofA", r"Bank\s+of\s+America\s+(?:Payment|CC\s+Pmt|Credit\s+Card\s+Pmt)", False),
    ("BofA", r"\bBOA\s+(?:CC|CARD|VISA)\s+PMT", False),
    ("Amex", r"American\s+Express\s+(?:ACH\s+Pmt|Epayment|EPAYMENT)", False),
    ("Amex", r"\bAMEX\s+EPAYMENT\b", False),
    ("Amex", r"\bAMERICAN\s+EXPRESS\s+\w+\s+M\d{3,5}\b", False),
    ("Robinhood", r"Robinhood\s+(?:Card\s+Payment|CRD\s+PMT|Credit\s+Pmt)", False),
    ("CapitalOne", r"CAPITAL\s+ONE\s+(?:MOBILE\s+PMT|CRD\s+PMT|ONLINE\s+PMT)", False),
    ("CapitalOne", r"\bCAPITAL\s+ONE\s+AUTOPAY\b", False),
    ("Citi", r"\bCITI(?:BANK|\s+CARD)?\s+(?:AUTOPAY|ONLINE|CRD\s+PMT)", False),
    ("WellsFargo", r"\bWF\s+(?:CREDIT\s+CARD\s+PMT|CRD\s+CARD\s+PMT|CRD\s+PMT)", False),
    ("WellsFargo", r"\bWELLS\s+FARGO\s+CARD\s+(?:PMT|PAYMENT)", False),
    ("Apple", r"GS\s+BANK\s+USA\s+(?:PMT|PAYMENT)", False),
    ("Apple", r"\bAPPLE\s+CARD\s+(?:PMT|PAYMENT)", False),
    ("Synchrony", r"\bSYNCHRONY\s+(?:BANK|PAYMENT|CRD\s+PMT)", False),
    ("Barclays", r"\bBARCLAYS?\s+(?:CARD|BANK)\s+(?:PMT|PAYMENT)", False),
]

# Bank names an issuer appears under on its own statements.
ISSUER_BANK_NAMES = {
    "Chase": ["Chase", "JPMorgan Chase"],
    "BofA": ["Bank of America", "BoA", "BofA"],
    "Amex": ["American Express", "Amex"],
    "Discover": ["Discover"],
    "Robinhood": ["Robinhood", "Robinhood Credit", "Robinhood Money"],
    "CapitalOne": ["Capital One"],
    "Citi": ["Citi", "Citibank"],
    "WellsFargo": ["Wells Fargo"],
    "Apple": ["Apple", "Apple Card", "Goldman Sachs"],
    "Synchrony": ["Synchrony"],
    "Barclays": ["Barclays", "Barclays Bank"],
}

# Bank-account description -> transaction type, after card payments.
TYPE_PATTERNS = [
    ("refund", r"Card\s+Purchase\s+Return\b"),
    ("transfer", r"Zelle\s+Payment\s+To\b"),
    ("deposit", r"Zelle\s+Payment\s+From\b"),
    ("deposit", r"(?:Payroll|Treas\s+\d+|Direct\s+Dep(?:osit)?|SSI|SOC\s+SEC)\b"),
    ("transfer", r"(?:Affirm\.Com|Klarna|Pennymac|Vw\s+Credit|Ford\s+Credit|Toyota\s+Financial|T-Mobile|Verizon|AT&T|PG&E|Electric|Water|Gas\s+Company|Mortgage|Loan\s+Pmt)"),
    ("transfer", r"\b(?:Wire\s+Transfer|DOMESTIC\s+WIRE|INTL\s+WIRE)\b"),
    ("withdrawal", r"\bATM\s+(?:WITHDRAWAL|CASH\s+WITHDRAWAL)"),
    ("fee", r"\b(?:OVERDRAFT\s+FEE|NSF\s+FEE|NON-SUFFICIENT\s+FUNDS|MONTHLY\s+(?:SERVICE\s+|MAINTENANCE\s+)?FEE|RETURNED\s+ITEM\s+FEE|WIRE\s+FEE|STOP\s+PAYMENT\s+FEE)\b"),
    ("interest", r"\b(?:INTEREST\s+(?:PAYMENT|EARNED|CREDIT))\b"),
    ("transfer", r"\bTransfer\b"),
]

# Card-statement credits that are payments rather than merchant credits.
CARD_CREDIT_PAYMENT = (
    r"\b(?:Payment\s+Thank\s+You|Mobile\s+Payment|AUTOPAY|Electronic\s+Payment"
    r"|ACH\s+Payment|E[-\s]?Payment|Online\s+Payment)\b"
)

# A description that hints at a transfer.
TRANSFER_HINT = r"transfer|xfer|to savings|to checking|wire|zelle|move to|online banking transfer"

# Tokens of bank plumbing that never identify a payer.
DESCRIPTOR_NOISE = ["PPD", "CCD", "WEB", "ID", "CONF", "REF", "TRACE", "ORIG", "CO"]

# CSV header spellings.
HEADER_ALIASES = {
    "date": ["date", "posted", "posted_date", "posted date", "transaction date", "trans date"],
    "description": ["description", "name", "memo", "details", "payee", "narration"],
    "amount": ["amount", "value"],
    "debit": ["debit", "withdrawal", "withdrawals", "money out"],
    "credit": ["credit", "deposit", "deposits", "money in"],
    "currency": ["currency", "ccy"],
    "category": ["category"],
}

# Keywords per spending intent; the first listed intent wins ties.
INTENT_KEYWORDS = {
    "food": [
        "chai", "coffee", "tea", "biryani", "lunch", "dinner", "breakfast", "brunch", "snack",
        "snacks", "milkshake", "restaurant", "cafe", "starbucks", "pizza", "burger", "meal",
        "food", "swiggy", "zomato", "doordash", "ubereats", "tiffin", "idli", "dosa", "samosa",
        "kebab", "kabab", "momo", "paratha", "thali", "curry", "roti", "naan", "ice cream",
        "icecream", "dessert", "sweet", "sweets", "cake", "pastry", "donut", "doughnut", "cookie",
        "chocolate", "gelato", "kulfi", "halwa", "kheer", "rasgulla", "gulab jamun", "jalebi",
        "mithai", "sandwich", "wrap", "salad", "soup", "noodles", "ramen", "sushi", "burrito",
        "taco", "kfc", "mcdonald", "chipotle", "subway", "dunkin", "panera", "taco bell",
    ],
    "groceries": [
        "groceries", "grocery", "bigbasket", "safeway", "kroger", "walmart", "costco", "target",
        "supermarket", "instacart", "whole foods",
    ],
    "transport": [
        "uber", "ola", "lyft", "metro", "bus", "train", "taxi", "auto", "rickshaw", "petrol",
        "gas", "fuel", "parking", "toll",
    ],
    "housing": ["rent", "mortgage", "maintenance"],
    "loans": ["emi", "loan"],
    "shopping": [
        "amazon", "flipkart", "shopping", "mall", "clothes", "apparel", "ebay", "etsy", "myntra",
    ],
    "health": ["gym", "doctor", "medicine", "pharmacy", "hospital", "medical", "clinic"],
    "entertainment": [
        "netflix", "spotify", "youtube", "movie", "concert", "cinema", "amazon prime", "disney",
        "hbo",
    ],
    "bills": [
        "electricity", "water", "wifi", "internet", "phone", "bill", "utility", "gas bill",
    ],
    "income": [
        "salary", "bonus", "paycheck", "pay check", "refund", "wage", "stipend", "cashback",
    ],
}

# Words dropped from the ends of a mined rule pattern.
LEADING_VERBS = [
    "ate", "drank", "had", "got", "paid", "spent", "bought", "purchased", "ordered", "eat",
    "drink", "drinking", "eating", "pay", "paying", "spend", "spending", "buy", "buying", "i",
    "just", "we", "a", "an", "the",
]
LEADING_PREPOSITIONS = ["on", "at", "for", "to", "from", "in", "of", "with"]
TRAILING_PREPOSITIONS = ["on", "at", "for", "to", "from", "in", "of", "with", "and"]

# Account words too common to name an account.
GENERIC_ACCOUNT_WORDS = [
    "cash", "card", "account", "acct", "bank", "credit", "debit", "checking", "chequing",
    "savings", "saving", "current", "wallet", "upi", "pay", "online", "the", "my",
]

# Account names that cannot carry a nickname.
RESERVED_ACCOUNT_NAMES = ["Cash", "Income", "Transfer"]

# Currency symbols of the money formatter.
CURRENCY_SYMBOLS = {"USD": "$", "INR": "₹"}

# Starter categories (name, color), most used first.
STARTER_CATEGORIES = [
    ("Groceries", "#10b981"), ("Food", "#f59e0b"), ("Transport", "#6366f1"), ("Gas", "#8b5cf6"),
    ("Rent/Mortgage", "#ef4d63"), ("Utilities", "#06b6d4"), ("Phone & Internet", "#14b8a6"),
    ("Insurance", "#84cc16"), ("Healthcare", "#ec4899"), ("Subscriptions", "#a855f7"),
    ("Shopping", "#f97316"), ("Travel", "#0ea5e9"), ("Entertainment", "#d946ef"),
    ("Education", "#22c55e"), ("Gifts/Family", "#fb7185"), ("Cash", "#64748b"),
    ("Fees & interest", "#dc2626"), ("Loan/Installment", "#7c3aed"), ("CC Payment", "#94a3b8"),
    ("Transfer", "#94a3b8"), ("Investment", "#0d9488"), ("Refund", "#22c55e"),
    ("Income (salary)", "#16a34a"), ("Income (other)", "#16a34a"),
]

# Statement signatures. A family fits when every pattern of one of its
# alternatives occurs and the `unless` pattern does not.
_OPERATOR_LABELS = [
    r"\bDays\s+in\s+Billing\s+Cycle\b", r"\+\s+FEE\s+CHARGED", r"\+\s+INTEREST\s+CHARGED",
    r"=\s+New\s+Balance\b", r"\+\s+Purchases\s+&\s+Other\s+Charges", r"-\s+Payments\s+&\s+Credits",
]
_ROBINHOOD_FIELDS = r"Account\s+Number:\s+X{4}|85\s+Willow\s+Road|Menlo\s+Park,\s+CA\s+94025"
_HYPHEN_ACCOUNT = r"Account\s*#?\s*XXXX[-\s]XXXX[-\s]XXXX[-\s]\d{4}"
SIGNATURES = {
    "amex": {
        "any": [
            [r"\b(?:Blue\s+Cash\s+(?:Everyday|Preferred)|Amex\s+(?:Gold|Platinum|Green|Business)|American\s+Express\s+Card)\b"],
            [r"\b(?:American\s+Express|americanexpress\.com)\b", r"Account\s+Ending\s+\d[-\s]?\d{3,6}"],
        ],
    },
    "bofa-credit-card": {
        "any": [
            [r"bankofamerica\.com"],
            [r"\bVisa\s+(?:Signature|Platinum)\b", _HYPHEN_ACCOUNT],
            [r"\bNew\s+Balance\s+Total\b", _HYPHEN_ACCOUNT],
        ],
    },
    "chase-checking": {
        "any": [[
            r"JPMorgan\s+Chase\s+Bank",
            r"\b(?:CHECKING\s+SUMMARY|\*start\*transactiondetail|Chase\s+(?:College|Total|Premier|Secure|High\s+School)\s+Checking)\b",
        ]],
        "unless": r"Chase\s+Card\s+Services",
    },
    "chase-credit-card": {
        "any": [
            [r"Chase\s+Card\s+Services"],
            [r"chase\.com/(?:cardhelp|amazon|paycard)"],
            [r"\bChase\b", r"ACCOUNT\s+SUMMARY[\s\S]+Credit\s+(?:Limit|Access\s+Line)"],
        ],
    },
    "discover-credit-card": {
        "any": [[r"\bDISCOVER\s+IT\b"], [r"\bDiscover\.com\b"], [r"\bCashback\s+Bonus\b"]],
    },
    "robinhood-credit-card": {
        "any": [[r"\bRobinhood\b", _ROBINHOOD_FIELDS]]
        + [[r"\bRobinhood\s+(?:Credit|Card)\b", label] for label in _OPERATOR_LABELS]
        + [
            [first, second]
            for i, first in enumerate(_OPERATOR_LABELS)
            for second in _OPERATOR_LABELS[i + 1:]
        ],
    },
}
