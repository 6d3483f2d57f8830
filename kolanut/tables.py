"""Labels, markers, word lists, menus and dictionaries that results depend on."""

# --- labels and markers of the generated text (fixed values) ------------------------------------
BLOCK_LABELS = ("USER2", "USER", "CALL", "PATCH", "RESULT", "ANSWER", "DECISION", "ASK")
VIDEO_LABELS = ("USER", "CALL", "RESULT", "ANSWER")
TURN_LABELS = ("USER", "ACT", "RESULT", "ANSWER")
USER, ASSISTANT, TOOLS = "<reserved_0>", "<reserved_1>", "<reserved_2>"
TOOL_CALL, TOOL_RESULT = "<reserved_3>", "<reserved_5>"
LEGACY_CALL, LEGACY_RESULT, LEGACY_ASSISTANT = "<|tool_call|>", "<|tool_result|>", "<|assistant|>"
PROBE_STOPS = (TOOL_RESULT, LEGACY_RESULT, ASSISTANT, LEGACY_ASSISTANT, USER)
VIDEO_STOPS = (TOOL_RESULT, LEGACY_RESULT, ASSISTANT, USER)
NONE_WORDS = ("NONE", "NULL", "N/A", "-")
NONE_WORDS_NARROW = ("NONE", "NULL")

TYPES = ("toolcall_api", "toolact", "seedance", "toolpatch", "toolrefuse", "tooldisambig", "toolsession")
CALL_TYPES = ("toolcall_api", "toolact", "seedance")
DUP = {"toolcall_api": 2, "toolact": 3, "seedance": 2, "toolpatch": 2,
       "toolrefuse": 1, "tooldisambig": 1, "toolsession": 2}
SHOW = {"toolcall_api": 1, "toolpatch": 2, "toolrefuse": 1, "tooldisambig": 1}
SHARD_TOKENS = 100_000_000
MIX_WEIGHTS = {"tools": 70, "replay": 30}
EOS_ID = 2
VOCAB_SIZE = 65536

# --- validation (fixed values) ------------------------------------------------------------------
PATCH_OPS = ("patch", "cancel", "confirm")
REFUSAL_REASONS = ("no_tool", "benign", "unsafe", "missing_info")
MODE_REASON = {"no_tool": "no_tool", "benign_answer": "benign",
               "unsafe_refuse": "unsafe", "missing_info": "missing_info"}
VIDEO_TOOL = "seedance_generate"
RATIOS = ("16:9", "9:16", "1:1", "4:3", "3:4", "21:9", "9:21")

# --- languages (fixed values) -------------------------------------------------------------------
NG = ("pcm", "yor", "ibo", "hau")
LANGS = ("pcm", "yor", "ibo", "hau", "swh", "sna", "zul", "eng")
VIDEO_TAIL = ("swh", "sna", "zul", "eng")
VIDEO_FOCUS = ("kin", "swh", "sna", "en")

YORUBA_MARKS = "ẹẸọỌṣṢ"
YORUBA_ONLY = "ẹẸṣṢ"
IGBO_MARKS = "ụỤịỊṅṄ"
IGBO_VOWELS = "ụỤịỊ"
HAUSA_MARKS = "ƙƘɗƊɓƁ"

PIDGIN_STRONG = ("dey", "wetin", "abeg", "sabi", "una", "o", "don")
HAUSA_STRONG = ("ana", "yanzu", "haka", "kuma", "nan", "muna", "naka")

PROBE_WORDS = {
    "yor": ("ni", "ti", "mo", "je", "ki", "owo", "se", "yin", "fun", "won", "pe", "awon"),
    "hau": ("na", "da", "ka", "ba", "yi", "wannan", "zan", "ne", "in", "sosai", "yin",
            "bidiyo", "bidiyon", "ku", "take", "gode"),
    "ibo": ("na", "ya", "ka", "maka", "gi", "nke", "ihe", "biko", "ndi", "anyi"),
    "pcm": ("abeg", "dey", "na", "make", "wetin", "don", "am", "sabi", "go", "fit", "una"),
    "eng": ("the", "your", "a", "is", "we", "will", "video", "clip", "making"),
    "zul": ("siyakwenza", "yakho", "i", "le", "kanye", "ngo", "uku", "isi", "wena", "futhi"),
    "sna": ("tiri", "kuita", "yako", "ne", "iyi", "uye", "kwa", "vanhu", "ndi", "pa"),
    "swh": ("tunatengeneza", "yako", "na", "ya", "wa", "kwa", "hii", "video", "ili", "katika"),
}
VIDEO_WORDS = {
    "yor": PROBE_WORDS["yor"],
    "hau": PROBE_WORDS["hau"],
    "ibo": PROBE_WORDS["ibo"],
    "pcm": PROBE_WORDS["pcm"],
    "en": PROBE_WORDS["eng"] + ("creating", "now"),
    "zul": PROBE_WORDS["zul"],
    "kin": ("turimo", "gukora", "videwo", "ngiye", "yawe", "rya", "mu", "ku", "n", "kandi",
            "igaragaza", "kugukorera", "cyangwa", "neza"),
    "sna": PROBE_WORDS["sna"] + ("vhidhiyo", "tichagadzira", "yenyu", "iyoyo", "kuti", "yacho", "mangwanani"),
    "swh": PROBE_WORDS["swh"],
}
LANG_ALIAS = {"eng": "en"}

# --- camera vocabulary (fixed values) -----------------------------------------------------------
SHOT_TERMS = ("extreme close-up", "close-up", "medium shot", "wide shot", "extreme wide shot",
              "two shot", "over-the-shoulder", "insert", "point of view")
MOVE_TERMS = ("dolly in", "dolly out", "tracking shot", "crane up", "pan", "tilt", "zoom",
              "steadicam follow shot", "handheld", "rack focus", "orbit shot", "whip pan", "static shot")
ANGLE_TERMS = ("low angle", "high angle", "overhead", "eye level", "dutch angle")
INVENTED_TERMS = ("bokeh pan", "snap zoom", "hyperlapse", "drone swoop", "vertigo", "parallax")
VERTICAL_WORDS = ("tiktok", "reels", "shorts", "status", "phone")
SQUARE_WORDS = ("instagram", "feed", "square")
WIDE_WORDS = ("youtube", "television", "tv", "cinema", "screen", "website", "advert")
CAMERA_CLAUSE = "the camera uses"
IMAGE_CLAUSE = "the image is"

# Script wording -> canonical term, per group. ``\b`` is a word edge over letters of any script.
DICTIONARY = {
    "shot": (
        (r"EXTREME CLOSE ?UPS?|ECU", "extreme close-up"),
        (r"CLOSE ?UPS?|CLOSE ON|CU\b", "close-up"),
        (r"MED(?:IUM)? (?:SHOT|ON)|MS\b", "medium shot"),
        (r"WIDE (?:SHOT|ON|ANGLE)|LONG SHOT|WS\b", "wide shot"),
        (r"EXTREME WIDE|ESTABLISHING(?: SHOT)?|AERIAL", "extreme wide shot"),
        (r"TWO ?SHOT", "two shot"),
        (r"OVER THE SHOULDER|O\.?T\.?S\.?", "over-the-shoulder"),
        (r"INSERT", "insert"),
        (r"P\.?O\.?V\.?", "point of view"),
    ),
    "move": (
        (r"DOLLY IN|PUSH(?:ES|ING)? IN|MOVE[SD]? IN", "dolly in"),
        (r"DOLLY OUT|PULL(?:S|ING)? BACK|PULL ?BACK", "dolly out"),
        (r"TRACK(?:S|ING)?|FOLLOW(?:S|ING)? (?:HIM|HER|THEM)", "tracking shot"),
        (r"CRANE|BOOM (?:UP|DOWN)", "crane up"),
        (r"PAN(?:S|NING)?\b", "pan"),
        (r"TILT(?:S|ING)?(?: UP| DOWN)?", "tilt"),
        (r"ZOOM(?:S|ING)?", "zoom"),
        (r"STEADICAM", "steadicam follow shot"),
        (r"HAND ?HELD", "handheld"),
        (r"RACK FOCUS", "rack focus"),
        (r"ORBIT|CIRCL(?:E|ES|ING)", "orbit shot"),
        (r"WHIP PAN", "whip pan"),
        (r"STATIC|LOCKED ?OFF", "static shot"),
    ),
    "angle": (
        (r"LOW ANGLE", "low angle"),
        (r"HIGH ANGLE", "high angle"),
        (r"OVERHEAD|BIRD'?S ?EYE|TOP DOWN", "overhead"),
        (r"EYE ?LEVEL", "eye level"),
        (r"DUTCH(?: ANGLE| TILT)?", "dutch angle"),
    ),
    "time": (
        (r"\bDAWN\b", "dawn"),
        (r"\bDAY\b", "day"),
        (r"\bDUSK\b", "dusk"),
        (r"\bNIGHT\b", "night"),
        (r"MAGIC HOUR|GOLDEN HOUR", "golden hour"),
        (r"\bSUNSET\b", "sunset"),
        (r"\bSUNRISE\b", "sunrise"),
    ),
}

# --- payment concepts (fixed values): description, canonical arguments, weight --------------------
CONCEPTS = {
    "transfer": ("Send money from the balance to a saved recipient", ("amount", "recipient", "reason", "currency"), 3),
    "balance": ("Check the available balance on the account", (), 2),
    "verify": ("Check whether a payment went through, using its reference", ("reference",), 2),
    "refund": ("Refund a transaction, fully or partially", ("transaction", "amount", "currency"), 4),
    "resolve": ("Look up the account holder name for a bank account number", ("account_number", "bank_code"), 5),
    "recipient": ("Save a bank account as a payout recipient", ("type", "name", "account_number", "bank_code"), 4),
    "vaccount": ("Create a dedicated virtual account number for a customer", ("customer", "preferred_bank"), 4),
    "banks": ("List the banks available in a country", ("country",), 1),
    "initpay": ("Start a payment and get a checkout link", ("email", "amount", "currency"), 2),
    "customer": ("Create a customer record", ("email", "first_name", "last_name"), 1),
    "airtime": ("Buy airtime or a data bundle for a phone number", ("amount", "phone", "network"), 2),
    "bill": ("Pay a utility or service bill", ("biller", "account", "amount"), 2),
}
ACT_WEIGHTS = {"transfer": 5, "refund": 4, "recipient": 3, "verify": 3, "balance": 3,
               "resolve": 2, "vaccount": 2, "customer": 2, "banks": 1}

# Tool names per naming style, in the order of CONCEPTS (fixed values).
STYLES = {
    "paystack": ("transfer_initiate", "balance_fetch", "transaction_verify", "refund_create",
                 "bank_resolveAccountNumber", "transferrecipient_create", "dedicatedAccount_create",
                 "bank_list", "transaction_initialize", "customer_create", "airtime_purchase", "bill_pay"),
    "verbnoun": ("send_money", "check_balance", "verify_payment", "issue_refund", "lookup_account_name",
                 "save_recipient", "create_virtual_account", "list_banks", "start_payment",
                 "add_customer", "buy_airtime", "pay_bill"),
    "camel": ("initiateTransfer", "fetchBalance", "verifyTransaction", "createRefund",
              "resolveAccountNumber", "createRecipient", "createVirtualAccount", "listBanks",
              "initializePayment", "createCustomer", "purchaseAirtime", "payBill"),
    "dotted": ("payouts.send", "wallet.balance", "charges.status", "charges.refund", "accounts.resolve",
               "payees.add", "vaccounts.open", "banks.index", "charges.create", "customers.add",
               "airtime.topup", "bills.settle"),
    "terse": ("pay", "bal", "chk", "rfnd", "whois", "payee", "vacct", "banks", "charge", "cust",
              "topup", "bill"),
}
ARG_NAMES = {
    "amount": ("amount", "value", "sum", "amount_kobo"),
    "recipient": ("recipient", "beneficiary", "payee", "destination", "recipient_code"),
    "reason": ("reason", "narration", "note", "description"),
    "currency": ("currency", "curr", "ccy"),
    "reference": ("reference", "ref", "txn_ref", "transaction_id"),
    "transaction": ("transaction", "txn", "charge_id"),
    "account_number": ("account_number", "acct_no", "nuban", "account"),
    "bank_code": ("bank_code", "bank", "institution_code", "sort_code"),
    "customer": ("customer", "customer_code", "customer_id"),
    "preferred_bank": ("preferred_bank", "provider", "bank_slug"),
    "email": ("email", "email_address", "customer_email"),
    "country": ("country", "country_code", "region"),
    "phone": ("phone", "msisdn", "phone_number"),
    "network": ("network", "operator", "telco"),
    "biller": ("biller", "service", "merchant"),
    "account": ("account", "account_ref", "meter_number"),
    "type": ("type", "recipient_type", "kind"),
    "name": ("name", "account_name", "full_name"),
    "first_name": ("first_name", "firstname", "given_name"),
    "last_name": ("last_name", "lastname", "surname"),
}
NUMERIC_ARGS = ("amount", "value", "sum", "amount_kobo")

EDITS = ("change the amount", "change the recipient", "add a reason", "remove the reason",
         "correct a name they got wrong", "change two fields at once", "cancel the whole thing",
         "confirm and go ahead")
AMBIGUITIES = ("two saved recipients share the same first name", "the bank was not named",
               "the amount could be naira or kobo", "they said 'my usual one' without saying which",
               "the currency is not stated and the account supports more than one")
MODES = ("no_tool", "benign_answer", "unsafe_refuse", "missing_info")
SHAPES = (
    "a transfer that gets corrected twice before it is confirmed",
    "check the balance, then send money, then ask what the reference was",
    "look up an account name, save the person as a recipient, then pay them",
    "start a refund, change the amount, then cancel it and say why",
    "pay one person, then say 'send the same to my brother' with a different name",
    "a transfer where the user changes their mind about the reason, then the amount",
    "verify a payment, find it failed, then start a fresh payment",
    "buy airtime, then ask an ordinary question the tools cannot answer, then send money",
    "send money, thank the assistant, then ask it to do the same again tomorrow",
    "create a customer, then a dedicated account for them, then read the number back",
)
MENU_SIZES = (5, 6, 6, 7)
SESSION_TURNS = (4, 4, 5, 5, 6, 6, 7)
# Rows wanted on top of the first wave, per type.
WANT = {"toolcall_api": 3200, "toolrefuse": 3400, "toolpatch": 4000, "toolsession": 4200}
# Pending-call fillers per wave: number, string, currency-like, reason-like.
FILLERS = {2: ("5000", "RCP_882", "RCP_882", "RCP_882"),
           5: ("25000", "RCP_4417", "NGN", "school fees")}

# --- video jobs (fixed values) --------------------------------------------------------------------
VIDEO_TOOLS = (
    (VIDEO_TOOL, "Generate a video clip from a text prompt with Seedance 2.5",
     (("prompt", "string"), ("aspect_ratio", "string"), ("resolution", "string"), ("duration", "number"),
      ("generate_audio", "boolean"), ("camera_fixed", "boolean"), ("seed", "number"))),
    ("seedance_image_to_video", "Animate a still image into a video clip",
     (("image_url", "string"), ("prompt", "string"), ("duration", "number"), ("aspect_ratio", "string"))),
    ("seedance_extend", "Extend an existing generated clip by a few more seconds",
     (("video_id", "string"), ("prompt", "string"), ("duration", "number"))),
    ("seedance_video_edit", "Edit an existing clip following an instruction",
     (("video_id", "string"), ("instruction", "string"))),
    ("seedance_job_status", "Check whether a generation job has finished", (("job_id", "string"),)),
    ("asset_upload", "Upload a reference image or audio file for use in a generation",
     (("file_url", "string"), ("kind", "string"))),
)
BRIEFS = (
    "a market trader wants a short clip for her WhatsApp status",
    "a musician wants a vertical teaser for TikTok",
    "a church wants an announcement clip for the screen at the front",
    "a football fan wants a Reels clip of a street match",
    "a jollof restaurant wants a square clip for Instagram",
    "a bank wants a fifteen second advert for television",
    "a student filmmaker wants an establishing shot for a short film",
    "a fashion label wants a lookbook clip for YouTube",
    "a farmer wants to show his harvest to a buyer abroad",
    "a wedding planner wants a teaser for the couple's status",
    "a radio station wants a visual for a song, cinema aspect",
    "a barber wants a clip of the shop for Shorts",
    "a tech startup wants a thirty second explainer for its website",
    "a grandmother wants a clip of the compound at dawn to send to her children",
    "a tour guide wants a wide cinematic view of the coastline",
    "a dancer wants a slow motion clip for Reels",
)
SEQUENCE_BRIEFS = (
    "a market trader wants to show her stall waking up, setting out, then the first customer",
    "a musician wants a teaser that moves from the empty stage to the crowd to the first chord",
    "a tour guide wants the coastline from far away, then closer, then a detail of the water",
    "a restaurant wants the pot, then the plating, then someone eating",
    "a tailor wants the cloth, then the machine, then the finished garment on someone",
    "a farmer wants the field at dawn, the harvest, then the load going to market",
    "a church wants the empty hall, the choir arriving, then the congregation standing",
    "a barber wants the empty chair, the cut in progress, then the customer's face at the end",
    "a school wants the gate opening, the classroom filling, then a child reading aloud",
    "a football club wants the street outside, the tunnel, then the first touch of the ball",
)
SINGLE_BRIEFS = (
    "a trader wants a short clip for her WhatsApp status",
    "a musician wants a vertical teaser for TikTok",
    "a bank wants a fifteen second advert for television",
    "a student filmmaker wants an establishing shot for a short film",
    "a cooperative wants a square clip for Instagram",
    "a tour operator wants a wide cinematic view for YouTube",
    "a grandmother wants a clip of the compound at dawn to send to her children",
    "a tech startup wants a thirty second explainer for its website",
)
SEQUENCE_SHOTS = (1, 1, 2, 3, 3, 4)
EMPTY_GRAMMAR_TERM = "medium shot"
