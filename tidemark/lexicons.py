"""Word lists and weights. All of them are fixed values that results depend on;
every operator also takes its own list as a parameter."""

# Words dropped by the tokenizer.
STOPWORDS = [
    "the", "and", "a", "to", "of", "in", "that", "is", "for", "it", "with", "as",
    "be", "on", "at", "this", "by", "an", "we", "our", "from", "your", "their",
    "has", "have", "had", "not", "but", "what", "all", "were", "when", "who",
    "will", "more", "if", "no", "or", "about", "which", "would", "there",
    "can", "also", "use", "any", "some", "they", "than", "then", "these", "such",
    "into", "out", "up", "down", "only", "just", "should", "now", "each", "over",
    "very", "may", "one", "like", "other", "how", "its", "his", "her", "them",
    "him", "she", "he", "been", "being", "am", "are", "was", "so",
]
# Terms whose TF-IDF weight is raised.
BOOST_TERMS = [
    "bitcoin", "ethereum", "blockchain", "crypto", "token", "defi", "nft",
    "wallet", "exchange", "mining", "node", "ledger", "smart contract",
    "decentralized", "transaction", "address", "key", "regulation", "compliance",
    "consensus", "hash", "digital asset", "whitepaper", "ico", "protocol",
]
# Sentiment words.
POSITIVE = [
    "bullish", "growth", "profit", "gain", "surge", "rise", "positive",
    "promising", "success", "opportunity", "uptrend", "breakthrough",
    "milestone", "achievement", "progress", "improve", "advantage",
    "rally", "boom", "soar", "jump", "recovery", "innovation", "partnership",
    "adoption", "agreement", "prospect", "potential", "upgrade",
]
NEGATIVE = [
    "bearish", "crash", "loss", "decline", "fall", "drop", "negative",
    "concern", "risk", "threat", "downtrend", "failure", "problem",
    "issue", "disaster", "crisis", "danger", "worry", "bear", "sell",
    "plunge", "plummet", "tumble", "weaken", "fear", "uncertainty",
    "volatility", "vulnerability", "weakness", "downgrade", "regulatory",
    "investigation", "lawsuit", "fine", "penalty", "scam", "fraud",
]
# Assets and the words that name them.
ASSETS = {
    "bitcoin": ["bitcoin", "btc", "satoshi"],
    "ethereum": ["ethereum", "eth", "ether", "erc20", "erc721"],
    "solana": ["solana", "sol"],
    "binance": ["binance", "bnb", "bsc"],
    "cardano": ["cardano", "ada"],
    "ripple": ["ripple", "xrp"],
    "dogecoin": ["dogecoin", "doge"],
    "polkadot": ["polkadot", "dot"],
    "avalanche": ["avalanche", "avax"],
    "tron": ["tron", "trx"],
    "litecoin": ["litecoin", "ltc"],
    "chainlink": ["chainlink", "link"],
    "polygon": ["polygon", "matic"],
    "uniswap": ["uniswap", "uni"],
    "stablecoin": ["usdt", "tether", "usdc", "dai", "busd"],
}
# Aspects in the order in which they are tested.
ASPECTS = [
    ("REGULATION", ["sec", "regulation", "lawsuit", "ban", "legal"]),
    ("CRYPTOCURRENCY", ["bitcoin", "ethereum", "solana", "crypto"]),
    ("MARKET", ["bullish", "bearish", "price", "market"]),
    ("TECHNOLOGY", ["blockchain", "nft", "smart contract", "web3"]),
]
# Phrases that identify a document kind.
DOC_TYPES = {
    "whitepaper": ["whitepaper", "white paper", "technical paper", "vision", "roadmap", "tokenomics", "utility", "use case", "ecosystem", "architecture"],
    "agreement": ["agreement", "contract", "terms", "conditions", "legal agreement", "token sale agreement", "purchase agreement", "service agreement",
                  "license agreement", "user agreement", "smart contract agreement"],
    "regulation": ["guidance", "advisory", "regulation", "compliance", "framework", "policy", "guideline", "rule", "directive", "regulatory", "regulator"],
    "legal_case": ["case", "court", "litigation", "plaintiff", "defendant", "judge", "ruling", "opinion", "decision", "versus", "v.", "appeal", "trial",
                   "indictment", "prosecution", "criminal", "civil action"],
    "financial_analysis": ["analysis", "report", "research", "market research", "investment", "projection", "forecast", "outlook", "performance", "trend",
                           "financial report", "quarterly report", "annual report"],
    "risk_assessment": ["risk assessment", "vulnerability", "threat", "risk factor", "red flag", "indicator", "warning sign", "suspicious", "monitor"],
}
# Phrases worth five points for their document kind.
DOC_TYPE_BONUS = {
    "legal_case": ["plaintiff", "defendant", "court"],
    "agreement": ["token sale", "purchase agreement"],
    "whitepaper": ["this whitepaper", "tokenomics"],
    "financial_analysis": ["market analysis", "price prediction"],
    "risk_assessment": ["red flag indicators", "suspicious activity"],
    "regulation": ["regulatory framework", "guidance"],
}
# Per category, the term list and the count that means 100.
CATEGORY_SCORES = {
    "technical": (["algorithm", "architecture", "blockchain", "consensus", "cryptography", "decentralized", "encryption", "hash", "implementation",
                   "protocol", "scalability", "security", "smart contract", "token", "transaction"], 50),
    "vulnerability": (["vulnerability", "exploit", "bug", "defect", "flaw", "issue", "critical", "high severity", "medium severity", "low severity",
                       "security risk", "attack vector"], 30),
    "legal": (["pursuant", "hereby", "regulation", "compliance", "jurisdiction", "statute", "provision", "aforementioned", "legal", "law", "liability",
               "enforcement", "violation", "clause", "penalty"], 40),
    "assessment": (["assessment", "evaluation", "analysis", "review", "finding", "recommendation", "conclusion", "scorecard", "rating", "grade",
                    "performance", "measure", "metric", "quality", "criteria"], 35),
}
# Risk categories, their terms and weights.
RISK_CATEGORIES = {
    "regulatory": ["regulatory", "regulation", "compliance", "legal", "jurisdiction", "restriction", "prohibited", "banned", "illegal", "unauthorized"],
    "financial": ["loss", "bankrupt", "insolvency", "debt", "liability", "expense", "cost", "inflation", "devaluation", "depreciation"],
    "technical": ["hack", "exploit", "vulnerability", "attack", "breach", "bug", "glitch", "failure", "malfunction", "error"],
    "operational": ["delay", "failure", "disruption", "interruption", "downtime", "outage", "maintenance", "discontinue", "cease", "halt"],
    "market": ["volatility", "fluctuation", "crash", "bear", "dump", "sell-off", "competition", "rival", "alternative", "substitute"],
    "fraud": ["scam", "fraud", "phishing", "fake", "counterfeit", "impersonation", "ponzi", "pyramid", "mlm", "money laundering"],
}
RISK_WEIGHTS = {"regulatory": 1.2, "financial": 1.0, "technical": 1.1, "operational": 0.9, "market": 0.8, "fraud": 1.3}
# Phrases and their points in the document risk score.
DOCUMENT_RISK = {
    "fraud": 30, "rug pull": 30, "money laundering": 30, "ponzi": 30, "regulatory breach": 25, "compliance issue": 25, "illegal": 25,
    "hacking": 25, "vulnerability": 20, "pump and dump": 20, "manipulation": 20, "spoofing": 15, "fake volume": 15, "lack of audit": 20,
    "undisclosed team": 20, "centralized control": 20, "regulated": -20, "licensed": -20, "audited": -25, "compliance certified": -30,
    "fully registered": -30, "security audit": -25, "iso certified": -20, "approved by authority": -25,
}
# Terms of the density risk score.
DENSITY_RISK = ["risk", "fraud", "scam", "hack", "vulnerability", "breach", "attack", "liability", "loss", "security"]
# Compliance topics and terms.
COMPLIANCE_TOPICS = {
    "kyc_aml": ["kyc", "know your customer", "aml", "anti-money laundering", "identity verification", "customer identification", "cip",
                "customer due diligence", "cdd"],
    "data_privacy": ["gdpr", "ccpa", "data protection", "privacy policy", "data privacy", "personal data", "data subject", "data rights"],
    "tax": ["tax", "taxation", "irs", "income tax", "capital gains", "tax reporting", "tax compliance", "tax liability", "fatca", "withholding"],
    "securities": ["security", "securities", "investment contract", "howey test", "sec", "securities and exchange commission", "regulated security"],
    "licensing": ["license", "licensed", "registration", "registered", "msa", "money services business", "money transmitter", "bitlicense",
                  "financial conduct authority"],
}
COMPLIANCE_TERMS = [
    "registration", "licensing", "securities", "commodity", "utility token", "security token", "money services business", "msb",
    "money transmitter", "virtual asset service provider", "vasp", "custody", "investor protection", "accredited investor",
    "qualified investor", "disclosure requirements", "reporting requirements", "safe harbor", "legal opinion", "jurisdictional",
    "cross-border", "sanctions", "ofac", "restricted territories", "travel rule",
]
# Risk indicators of the domain.
RISK_INDICATORS = [
    "multiple transactions", "structuring", "smurfing", "layering", "mixing", "tumbling", "obfuscate", "anonymous", "privacy coin",
    "mixer", "tumbler", "P2P platform", "darknet", "dark web", "suspicious", "unusual pattern", "shell company", "unregistered", "unlicensed",
    "sanctioned", "fraud", "scam", "ponzi", "pyramid scheme", "ransomware", "extortion", "hacked", "stolen funds", "illicit", "illegal",
    "criminal", "refused to provide", "false identification", "forged documents", "front company", "no economic purpose", "high-risk jurisdiction",
    "tax haven", "non-cooperative", "politically exposed person", "PEP", "high-risk customer", "high-risk country",
    "sanctioned country", "non-compliant", "terrorism", "terrorist financing", "drug trafficking", "human trafficking", "arms trafficking",
]
HIGH_RISK_ACTIVITIES = ["fraud", "scam", "ponzi", "ransomware", "extortion", "illicit", "illegal"]
DOMAIN_RISKS = [
    "private key management", "key management practices", "custody solution", "cold storage", "hot wallet", "smart contract vulnerabilities",
    "audit", "third-party audit", "security audit", "code review", "code audit", "flash loan", "reentrancy attack", "frontrunning",
    "oracle manipulation", "market manipulation", "wash trading", "pump and dump", "rug pull", "exit scam", "team anonymity",
    "anonymous team", "regulatory risk", "jurisdictional risk", "security breach", "hack", "exploit", "liquidity risk",
    "impermanent loss", "token distribution", "token inflation", "centralization risk", "governance risk", "excessive token allocation",
    "vesting schedule", "emission rate", "unaudited code", "admin keys", "backdoor", "upgradability risk", "fork risk", "chain re-org",
    "51% attack",
]
SECURITY_TERMS = [
    "security", "secure", "vulnerability", "vulnerabilities", "audit", "audited", "safety", "protection", "safeguard", "backup",
    "backups", "encrypted", "encryption", "firewall",
]
# Regulators, jurisdictions, legal actions and penalties.
REGULATORS = {
    "us": ["sec", "securities and exchange commission", "cftc", "commodity futures trading commission", "finra",
           "financial industry regulatory authority", "fincen", "financial crimes enforcement network"],
    "uk": ["fca", "financial conduct authority", "pra", "prudential regulation authority"],
    "eu": ["esma", "european securities and markets authority", "eba", "european banking authority"],
    "global": ["fatf", "financial action task force", "iosco", "international organization of securities commissions"],
    "asia": ["mas", "monetary authority of singapore", "sfc", "securities and futures commission", "fsa", "financial services agency", "jfsa"],
}
JURISDICTIONS = {
    "us": ["united states", "u.s.", "usa", "america"],
    "uk": ["united kingdom", "u.k.", "britain", "england"],
    "eu": ["european union", "eu", "europe"],
    "asia": ["china", "japan", "singapore", "hong kong", "south korea"],
    "other": ["canada", "australia", "brazil", "switzerland", "uae", "dubai"],
}
LEGAL_ACTIONS = ["complaint", "indictment", "lawsuit", "litigation", "prosecution", "investigation", "subpoena", "cease and desist", "injunction",
                 "allegation", "charge"]
PENALTIES = ["penalty", "fine", "sanction", "forfeit", "disgorgement", "cease and desist", "injunction", "ban", "prohibition", "barred"]
REQUIREMENT_WORDS = ["must", "required", "shall", "mandatory", "obligation", "comply", "compliance", "adhere"]
# Regulators and requirements per jurisdiction, for the compliance score.
REGULATORY_BODIES = {
    "US": ["SEC", "FinCEN", "CFTC", "FINRA", "OCC", "FDIC", "IRS", "MSB"],
    "EU": ["ESMA", "EBA", "MiCA", "AMLD5", "VASP", "NCA"],
    "UK": ["FCA", "PRA", "HMRC", "MLR"],
    "Singapore": ["MAS", "PSA"],
    "Hong Kong": ["SFC", "HKMA"],
    "Japan": ["FSA", "JFSA"],
    "Switzerland": ["FINMA", "SBA", "VQF"],
    "Cayman Islands": ["CIMA", "CIR"],
    "BVI": ["FSC", "SIBA"],
    "Bermuda": ["BMA", "DABA"],
    "Australia": ["ASIC", "AUSTRAC"],
    "Canada": ["CSA", "OSC", "FINTRAC"],
    "Dubai": ["DFSA", "VARA"],
}
KYC_REQUIREMENTS = {
    "US": ["Customer identification", "KYC verification", "BSA compliance", "SAR filing", "AML program"],
    "EU": ["KYC/CDD procedures", "AMLD5 compliance", "UBO registry", "PEP screening"],
    "UK": ["MLR 2017 procedures", "AML risk assessment", "Customer due diligence"],
    "Singapore": ["MAS Notice PSN02", "Risk-based approach", "CDD measures"],
    "Switzerland": ["FINMA circular 2016/7", "AMLA compliance", "Risk categorization"],
    "Cayman Islands": ["AML regulations", "Cayman KYC standards"],
}
TAX_REQUIREMENTS = {
    "US": ["1099 forms", "FinCEN Form 114", "Form 8949", "Schedule D"],
    "EU": ["Tax information exchange", "Cross-border reporting", "DAC8 compliance"],
    "UK": ["HMRC reporting", "CTF compliance"],
    "Singapore": ["GST reporting", "Annual returns"],
    "Switzerland": ["AEOI reporting", "Tax compliance"],
    "Cayman Islands": ["Economic substance", "FATCA/CRS reporting"],
}
# Topics of a document.
TOPICS = [
    "blockchain", "cryptocurrency", "token", "risk", "investment", "regulation", "compliance", "security", "investor", "trading",
    "exchange", "liquidity", "market", "volatility", "governance", "defi", "nft", "staking", "mining", "wallet", "smart contract",
    "consensus", "protocol", "yield", "apy", "apr", "tokenomics", "ico", "airdrop", "whitepaper", "roadmap", "audit", "hash", "kyc",
    "aml", "tax", "legal", "jurisdiction", "license", "custody",
]
NODE_TERMS = ["token", "crypto", "blockchain", "contract", "agreement", "regulation", "compliance", "sec", "legal", "financial", "trading",
              "exchange", "asset", "digital", "network"]
RISK_SENTENCE_TERMS = [
    "risk", "threat", "vulnerability", "exposure", "danger", "hazard", "uncertainty", "volatility", "concern", "issue", "problem",
    "challenge", "liability", "loss", "penalty", "fine", "sanction", "regulatory action", "lawsuit", "litigation", "compliance",
    "breach", "violation", "failure", "security", "hack", "attack", "exploit", "fraud", "scam", "theft",
]
# Sentence cues of the summary, by document kind and general.
SUMMARY_CUES = {
    "whitepaper": ["purpose", "vision", "mission", "objective", "goal", "aims to", "designed to"],
    "agreement": ["agree", "terms", "condition", "party", "obligation", "shall", "must", "covenant"],
    "regulation": ["require", "prohibit", "must", "shall", "regulate", "compliance", "subject to"],
    "legal_case": ["court", "ruled", "decision", "judgment", "opinion", "held", "concluded"],
    "financial_analysis": ["analysis", "shows", "indicates", "concludes", "predicts", "projects", "estimates"],
    "risk_assessment": ["risk", "warning", "indicator", "flag", "suspicious", "monitor", "detect"],
}
SUMMARY_GENERAL = ["key", "important", "significant", "critical", "essential", "conclusion", "summary", "in summary", "to summarize", "in conclusion"]
# Cues of the question classifier.
INTENTS = {
    "information": ["what", "explain", "describe", "tell", "information", "details", "overview"],
    "analysis": ["analyze", "assessment", "evaluate", "review", "pros", "cons", "swot", "strength", "weakness"],
    "price": ["price", "value", "worth", "cost", "trading", "exchange rate", "market value"],
    "prediction": ["predict", "forecast", "projection", "future", "will", "expect", "anticipate"],
    "recommendation": ["recommend", "suggest", "should", "best", "advise", "advice", "opinion"],
    "instruction": ["how", "steps", "guide", "tutorial", "instructions", "process", "procedure"],
    "comparison": ["compare", "comparison", "versus", "vs", "difference", "similar", "better", "worse"],
    "risk_assessment": ["risk", "exposure", "vulnerability", "danger", "threat", "potential downside"],
    "due_diligence": ["due diligence", "dd", "thorough investigation", "comprehensive evaluation"],
}
PAST_WORDS = ["was", "were", "did", "had", "happened", "occurred", "previous", "historically", "before", "earlier", "last", "past", "history"]
FUTURE_WORDS = ["will", "going to", "shall", "may", "might", "could", "would", "predict", "forecast", "projection", "expect", "anticipate",
                "future", "soon", "upcoming", "next", "tomorrow"]
COMPARISON_WORDS = ["compare", "comparison", "versus", "vs", "vs.", "difference", "differences", "similar", "similarities", "better", "worse",
                    "best", "worst", "stronger", "weaker", "faster", "slower", "higher", "lower", "more", "less", "or", "rather than",
                    "compared to", "against", "between"]
LOGICAL_WORDS = ["and", "or", "but", "however", "although", "if", "despite", "while", "whereas", "nevertheless", "furthermore", "therefore"]
PERIODS = [
    ("today", ["today", "now", "current", "currently", "present"]),
    ("yesterday", ["yesterday"]),
    ("this_week", ["this week", "current week", "past week"]),
    ("last_week", ["last week", "previous week"]),
    ("this_month", ["this month", "current month"]),
    ("last_month", ["last month", "previous month"]),
    ("this_year", ["this year", "current year", "2025"]),
    ("last_year", ["last year", "previous year", "2024"]),
]
QUESTION_STARTS = [
    ("factual", ["what ", "which ", "who "]),
    ("procedural", ["how ", "in what way "]),
    ("explanatory", ["why ", "for what reason "]),
    ("yes_no", ["is ", "are ", "do ", "does ", "can ", "could ", "will ", "would "]),
    ("comparative", ["compare "]),
    ("circumstantial", ["when ", "where "]),
]
# Tables to search per question category and per intent.
CATEGORY_TABLES = {
    "legal_regulatory": ["user_documents", "documents"], "team_background": ["user_documents", "documents"],
    "technical": ["user_documents", "documents"], "financial": ["user_documents", "documents", "market"],
    "market_price": ["market", "time_series", "news"], "market_analysis": ["news", "market", "user_documents", "documents"],
    "governance": ["user_documents", "documents", "news"], "risk": ["user_documents", "documents", "news", "onchain"],
    "sentiment": ["news"], "on_chain": ["onchain"], "defi": ["user_documents", "documents", "news"],
    "nft": ["user_documents", "documents", "news"], "macroeconomic": ["news", "user_documents", "documents"],
    "comparative": ["user_documents", "documents", "market", "time_series"], "due_diligence": ["user_documents", "documents"],
    "general": ["user_documents", "documents", "news", "market"],
}
INTENT_TABLES = {
    "price": ["market", "time_series"], "prediction": ["forecasts", "news"], "recommendation": ["documents", "news"],
    "risk_assessment": ["documents", "onchain"], "due_diligence": ["documents"],
}
# Token groups.
TOKEN_CATEGORIES = {
    "stablecoins": ["USDT", "USDC", "DAI", "BUSD", "TUSD", "USDP"],
    "defi": ["AAVE", "COMP", "UNI", "SUSHI", "YFI", "MKR", "SNX", "CRV"],
    "gaming": ["MANA", "AXS", "SAND", "ENJ", "GALA"],
    "exchange_tokens": ["BNB", "CRO", "FTT", "LEO", "HT", "KCS"],
    "privacy": ["ZEC", "XMR", "DASH", "SCRT"],
}
# Protocol kinds with the words that reveal them, in test order, and their risk on a 0-10 scale.
PROTOCOL_KINDS = [
    ("lending", ["lending", "aave", "compound", "maker"], 6.5),
    ("dex", ["dex", "uniswap", "sushiswap", "curve", "balancer", "swap"], 6.0),
    ("yield_farming", ["yield", "farm", "harvest", "yearn"], 7.5),
    ("bridge", ["bridge", "wormhole", "multichain"], 8.0),
    ("staking", ["stake", "lido", "rocket"], 5.0),
    ("nft", ["nft", "collectible"], 5.5),
]
DEFI_WORDS = ["aave", "compound", "uniswap", "sushiswap", "curve", "yearn", "maker", "balancer", "synthetix", "1inch", "pancakeswap", "dydx",
              "lido", "rocket pool", "yield", "farm", "stake", "pool", "liquid"]
# Liquidity tiers of the two liquidity models.
ILLIQUID_WORDS = ["nft", "locked", "stake", "illiquid", "private", "seed", "vesting"]
LIQUID_WORDS = ["cash", "stablecoin", "usdc", "usdt", "dai", "busd"]
MAJOR_WORDS = ["bitcoin", "btc", "ethereum", "eth", "bnb", "sol", "ada", "xrp"]
# Volatility by asset name, first name contained in the asset wins; 0.8 otherwise.
VOLATILITY_CLASS = {
    "Bitcoin": 0.8, "BTC": 0.8, "Ethereum": 0.85, "ETH": 0.85, "Solana": 0.9, "SOL": 0.9, "Binance Coin": 0.8, "BNB": 0.8, "Cardano": 0.85,
    "ADA": 0.85, "Ripple": 0.8, "XRP": 0.8, "Polkadot": 0.85, "DOT": 0.85, "Dogecoin": 0.95, "DOGE": 0.95, "Stablecoin": 0.1, "USDT": 0.1,
    "USDC": 0.1, "DeFi Protocol": 0.9, "NFT": 0.95, "Layer 2": 0.85, "Cash": 0.0,
}
# Assets a holding name or a wallet token implies.
EXPOSURE_NAMES = [("bitcoin", ["bitcoin", "btc"]), ("ethereum", ["ethereum", "eth"]), ("solana", ["solana", "sol"]), ("binance", ["binance", "bnb"]),
                  ("cardano", ["cardano", "ada"]), ("ripple", ["ripple", "xrp"])]
EXPOSURE_TOKENS = {"btc": "bitcoin", "wbtc": "bitcoin", "eth": "ethereum", "weth": "ethereum", "sol": "solana", "bnb": "binance", "ada": "cardano",
                   "xrp": "ripple"}
# Component weights of the two overall risk models.
RISK_MODEL = {"market_risk": 0.25, "smart_contract_risk": 0.20, "regulatory_risk": 0.15, "liquidity_risk": 0.15, "operational_risk": 0.15,
              "concentration_risk": 0.10}
RISK_MODEL_WALLET = {"wallet_security": 0.20, "portfolio": 0.15, "market": 0.15, "smart_contract": 0.15, "compliance": 0.15, "operational": 0.10,
                     "liquidity": 0.10}
# What to do about a risk factor whose name contains the phrase, first match wins.
MITIGATIONS = [
    ("volatility", "Hedge or move into lower volatility assets"),
    ("drawdown", "Review stop-loss strategy and position sizing"),
    ("correlation", "Add assets with low or negative correlation"),
    ("defi exposure", "Limit DeFi exposure and vet protocols for audits"),
    ("high-risk protocols", "Reduce exposure to experimental protocols"),
    ("compliance gap", "Consult counsel on the compliance gaps"),
    ("no registration", "Consult counsel on the compliance gaps"),
    ("kyc/aml", "Strengthen KYC/AML procedures"),
    ("liquidity mismatch", "Align redemption terms with portfolio liquidity"),
    ("illiquid allocation", "Align redemption terms with portfolio liquidity"),
    ("low liquid reserves", "Raise cash or stablecoin reserves"),
    ("team undocumented", "Document or strengthen the team"),
    ("security team", "Establish security processes and regular audits"),
    ("multi-sig", "Use multi-signature wallets for significant holdings"),
    ("hardware", "Use hardware security for cold storage"),
    ("asset concentration", "Diversify holdings"),
    ("dominant holding", "Diversify holdings"),
    ("wallet concentration", "Spread funds over more secure wallets"),
    ("ecosystem concentration", "Diversify across ecosystems"),
]
