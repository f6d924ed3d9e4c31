"""Tables, patterns and formats that decide results, in their natural order."""

# Category rules (category, pattern, direction it needs or None); the first that matches counts.
RULES = [
    ("Salary", r"salary|payroll|stipend|\bsal\s*cr\b|emolument", "cr"),
    ("Interest Income", r"\bint\.?\s*(pd|paid|credit|cr)\b|interest\s*credited|savings\s*int", "cr"),
    ("Dividend", r"dividend|div\s*paid|nsdl.*div|cdsl.*div", "cr"),
    ("Refund / Reversal", r"refund|reversal|\brev\b|cashback|chargeback|reimburs", "cr"),
    ("Cash Withdrawal (ATM)", r"\batm\b|\bnwd\b|cash\s*(wdl|withdrawal)|\bcwdr\b|atm\s*cash", "dr"),
    ("Cash Deposit", r"cash\s*dep|\bcdm\b|by\s*cash|cash\s*deposi", "cr"),
    ("Bank Charges & Fees", r"charges?\b|\bchrg|\bfee\b|igst|cgst|sgst|sms\s*alert|\bamc\b|min(imum)?\s*bal|penalty|annual\s*fee|service\s*charge|locker\s*charge|processing\s*fee|late\s*payment", "dr"),
    ("Tax", r"income\s*tax|\bitd\b|\btds\b|cbdt|advance\s*tax|gst\s*payment|tds\s*deducted|challan", None),
    ("EMI / Loan", r"\bemi\b|loan|repayment|bajaj\s*fin|\bnach\b.*\bfin|equit[ae]d|principal|lic\s*housing|pnb\s*housing|home\s*loan|vehicle\s*loan|personal\s*loan", "dr"),
    ("Insurance", r"\blic\b|insurance|premium|policybazaar|star\s*health|hdfc\s*life|icici\s*pru|max\s*life|sbi\s*life|tata\s*aia|care\s*health|niva\s*bupa", "dr"),
    ("Investments", r"zerodha|groww|upstox|\bsip\b|mutual\s*fund|\bnps\b|\bppf\b|kuvera|indmoney|\bnsdl\b|\bcdsl\b|smallcase|coin\s*by|demat|nifty\s*bees|ipo\s*allot|subscription\s*fee.*fund", None),
    ("Food & Dining", r"swiggy|zomato|domino|mcdonald|\bkfc\b|restaurant|cafe|starbucks|pizza|eatsure|burger|dunkin|subway|haldiram|barbeque|biryani|fresh\s*menu|box8|faasos|inner\s*chef", "dr"),
    ("Groceries", r"bigbasket|blinkit|zepto|dmart|grofers|instamart|reliance\s*fresh|grocer|supermarket|\bmilk\b|nature\s*basket|more\s*retail|lulu|spar", "dr"),
    ("Shopping", r"amazon|flipkart|myntra|ajio|meesho|nykaa|decathlon|ikea|croma|reliance\s*digital|snapdeal|paytm\s*mall|tata\s*cliq|shopclues|firstcry|babyoye|lifestyle|pantaloon|westside|max\s*fashion|\bshopify\b", "dr"),
    ("Transport & Fuel", r"\buber\b|\bola\b|rapido|fuel|petrol|diesel|\bhpcl\b|\bbpcl\b|\biocl\b|indian\s*oil|fastag|metro\s*rail|rapido|\bnamma\s*metro\b|auto\s*rickshaw|cab|parking", "dr"),
    ("Travel", r"irctc|makemytrip|goibibo|indigo|air\s*india|cleartrip|redbus|ixigo|\boyo\b|airbnb|yatra|abhibus|spicejet|vistara|akasa|easemytrip|hotel|resort|booking\.com", "dr"),
    ("Utilities & Bills", r"electric|bescom|mseb|torrent\s*power|tata\s*power|water\s*bill|piped\s*gas|billdesk|bbps|bill\s*pay|mahanagar\s*gas|igl\b|mgl\b|adani\s*gas|cesc\b|tneb\b|kseb\b|wesco\b|nesco\b|reliance\s*energy", "dr"),
    ("Mobile & Internet", r"airtel|jio\b|vodafone|\bvi\b|bsnl|recharge|broadband|fibernet|hathway|tata\s*play|act\s*fibernet|den\s*networks|you\s*broadband|excitel|beam\s*fiber", "dr"),
    ("Entertainment", r"netflix|spotify|hotstar|prime\s*video|bookmyshow|\bpvr\b|\binox\b|youtube|sony\s*liv|zee5|lionsgate|apple\s*tv|disney\s*plus|mxplayer|jio\s*cinema|aha\b|voot", "dr"),
    ("Healthcare", r"pharmacy|apollo|medplus|hospital|clinic|\b1mg\b|pharmeasy|diagnostic|netmeds|practo|lal\s*path|thyrocare|fortis|max\s*hospital|manipal|aiims", "dr"),
    ("Education", r"school|college|universit|tuition|udemy|coursera|exam\s*fee|byju|unacademy|vedantu|simplilearn|khan\s*academy|upgrad|whitehat|coding\s*ninjas", "dr"),
    ("Rent", r"\brent\b|landlord|nobroker|magicbricks|99acres|housing\.com|maintenance\s*charge|society\s*charge", "dr"),
    ("Wallet / UPI", r"paytm|phonepe|googlepay|\bgpay\b|amazon\s*pay|mobikwik|freecharge|cred\b|slice\b|jupiter\b|\bfi\b\s*money|navi\b|bhim\b", None),
    ("Self Transfer", r"\bself\b|own\s*account|to\s*self|a/?c\s*to\s*a/?c", None),
    ("Cheque", r"\bchq\b|cheque|\bclg\b|clearing\b|instrument", None),
    ("Transfers (Person)", r"\bupi\b|\bneft\b|\bimps\b|\brtgs\b", None),
]
FALLBACK, RULE_CONFIDENCE, MIN_CONFIDENCE = "Others", 0.95, 0.50

# Words that are never a counterparty.
NOISE = (
    "upi neft imps rtgs ach nach pos ecom payment from to dr cr ref trf transfer ybl okaxis oksbi okicici paytm ibl axl sbi hdfc icici axis "
    "kotak pnb canara union federal yes indus rbl au idfc fino airtel"
).split()

# Header words of each column.
HEADER_WORDS = {
    "date": "date dt txndate transactiondate valuedate transdate",
    "desc": "description narration particulars details remarks transactiondetails narration/description particular",
    "debit": "debit debits withdrawal withdrawals withdrawl dr debit(dr) withdrawalamt withdraw withdraws debitamount wdl",
    "credit": "credit credits deposit deposits cr credit(cr) depositamt creditamount deposited",
    "balance": "balance bal runningbalance closingbalance outstandingbalance",
    "amount": "amount amt withdrawalamount depositamount",
    "ref": "chq cheque ref reference refno chqno chequeno instrumentno sl.no",
    "type": "dr/cr drcr type txntype",
    "serial": "si s.no sno sr srno slno serialno no.",
}
DATE_PREFIXES = ["txn", "tran", "trans", "transaction", "posting", "post", "booking"]
VALUE_PREFIXES = ["value", "val", "valu"]
NUMERIC = ["debit", "credit", "balance", "amount"]

# Amounts, tags, dates, and lines that are no transactions.
AMOUNT = r"\(?-?(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?\)?(?:Dr|Cr)?\.?"
STRICT_AMOUNT = r"\(?-?(?:\d{1,3}(?:,\d{2,3})+|\d+)\.\d{2}\)?(?:Dr|Cr)?\.?"
DECIMAL_AMOUNT = r"\(?-?\d[\d,]*\.\d{2}\)?(?:Dr|Cr)?\.?"
TAG = r"(?:dr|cr)\.?"
DATE = r"(?<!\d)(\d{1,2}\s*[/\-.]\s*(?:\d{1,2}|[A-Za-z]{3,9})(?:\s*[/\-.]\s*\d{2,4})?|\d{1,2}\s+[A-Za-z]{3,9}(?:\s+\d{2,4})?|\d{4}-\d{2}-\d{2})(?!\d)"
FOOTER = (
    r"(page\s+\d+|statement\s+summary|closing\s+balance|^total\b|registered\s+office|computer\s+generated|end\s+of\s+statement"
    r"|legends|carried\s+forward|continued\s+on|opening\s+balance\s*:|^summary\s*:|total\s+debit|total\s+credit|grand\s+total"
    r"|linked\s+casa|no\s+records\s+found|please\s+do\s+not\s+share|bank\s+never\s+asks\s+for)"
)
OPENING = r"opening\s+balance|balance\s+b/?f|brought\s+forward|b/f\b"
REFERENCE = r"(?<![A-Za-z0-9])([A-Z]{0,2}\d{6,})(?![A-Za-z0-9])"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# The bank of each IFSC prefix, in the order in which names are looked for.
BANKS = {
    "HDFC": "HDFC Bank", "SBIN": "State Bank of India", "ICIC": "ICICI Bank", "UTIB": "Axis Bank", "KKBK": "Kotak Mahindra Bank",
    "BARB": "Bank of Baroda", "PUNB": "Punjab National Bank", "CNRB": "Canara Bank", "UBIN": "Union Bank of India", "BKID": "Bank of India",
    "IDFB": "IDFC First Bank", "YESB": "Yes Bank", "INDB": "IndusInd Bank", "IOBA": "Indian Overseas Bank", "FDRL": "Federal Bank",
    "AUBL": "AU Small Finance Bank", "ESFB": "Equitas Small Finance Bank", "UJVN": "Ujjivan Small Finance Bank", "FINO": "Fino Payments Bank",
    "AIRP": "Airtel Payments Bank", "PAYT": "Paytm Payments Bank", "JAKA": "Jammu & Kashmir Bank", "ALLA": "Allahabad Bank", "ANDB": "Andhra Bank",
    "CORP": "Corporation Bank", "SIBL": "South Indian Bank", "KVBL": "Karur Vysya Bank", "CITI": "Citibank", "HSBC": "HSBC Bank",
    "DEUT": "Deutsche Bank", "RATN": "RBL Bank", "NKGS": "NKGSB Co-operative Bank", "MAHB": "Bank of Maharashtra",
    "ORBC": "Oriental Bank of Commerce", "VIJB": "Vijaya Bank", "IDIB": "Indian Bank",
}

# What ends a value in an account header, and the header patterns.
STOP = r"(?=\s+(?:a/?c|account|cust|ifsc|micr|branch|address|date|pan|mobile|email|nominee|currency|statement|from|to|period|balance)\b|$)"
HOLDER = [
    r"(?:account\s*holder'?s?\s*name|customer\s*name|account\s*name)\s*[:\-]\s*([A-Za-z][A-Za-z .&']{2,60}?)" + STOP,
    r"^name\s*[:\-]\s*([A-Za-z][A-Za-z .&']{2,60}?)" + STOP,
    r"^(?:mr|mrs|ms|m/s|shri|smt)\.?\s+([A-Za-z .]{3,60})$",
]
IFSC = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
IFSC_MISREAD = r"\b([A-Z]{4})O([A-Z0-9]{6})\b"
ACCOUNT = r"(?:a/?c|account)\s*(?:no|number|num|#)?\.?\s*[:\-]?\s*([Xx*\d]{6,20})"
BRANCH = r"branch(?:\s*name)?\s*[:\-]\s*([A-Za-z0-9 ,.&'_\-]{2,60}?)" + STOP
CUSTOMER = r"(?:cust(?:omer)?|cif)\s*(?:id|no)\.?\s*[:\-]?\s*(\w{5,})"
PAN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
MOBILE = r"(?:mobile|mob|phone|ph\.?)\s*[:\-]?\s*(\+?[0-9 \-]{10,14})"
EMAIL = r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
MICR = r"micr\s*(?:code|no)?\s*[:\-]?\s*(\d{9})"
PERIOD = r"(?:from|period|between|statement\s+date)\s*:?\s*(.{6,16}?)\s*(?:to|till|and|(?<=\d)\s*-\s*(?=\d))\s*(.{6,16})"
PRINTED_OPENING = r"(?:opening\s+balance|balance\s+b/?f|brought\s+forward)\s*[:\-]?\s*([\d,]+\.?\d*)"
PRINTED_CLOSING = r"(?:closing\s+balance|balance\s+c/?f|carried\s+forward)\s*[:\-]?\s*([\d,]+\.?\d*)"
CURRENCY_SIGNS = [("₹", "INR"), ("$", "USD"), ("€", "EUR"), ("£", "GBP")]

# Thresholds.
TOLERANCE, ANOMALY_SIGMAS, SIMILAR_PAYEE, SIMILAR_MOST = 0.005, 3.0, 0.75, 15
OCR_SCORE, OCR_CONFIDENCE, TEXT_PAGE_WORDS = 0.60, 25.0, 20
LINE_GAP, COLUMN_GAP, NUMBER_GAP, HEADER_GAP = 2.8, 30.0, 25.0, 30.0
