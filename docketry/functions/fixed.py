"""Word lists and patterns whose results other tools rely on, stated whole and in their natural order.

Patterns are matched without regard to case unless they say otherwise.  Tables
that an office maintains (taxonomy, aliases, blocklists, sites) aren't here:
they are parameters (``docketry.config``).
"""

# --- enforcement filter: words of the opening that speak for and against -----------------
ENFORCEMENT_WORDS = [
    "settlement", "consent decree", "lawsuit", "complaint filed", "assurance of discontinuance", "civil penalty", "civil penalties", "injunctive relief", "injunction", "violated",
    "enforcement action", "sentenced", "sentencing", "convicted", "conviction", "indictment", "indicted", "pleaded guilty", "pled guilty", "plea agreement", "judgment", "restitution",
    "sues", "sued", "files suit", "filed suit", "files complaint", "filed complaint", "files action", "filed action", "files lawsuit", "filed lawsuit", "legal action", "cease and desist",
    "preliminary injunction", "permanent injunction", "consent order", "stipulated order", "held accountable",
]
OTHER_WORDS = [
    "consumer alert", "consumer tips", "consumer advisory", "advisory", "awareness", "recognizes", "congratulates", "testimony", "legislative", "amicus brief", "friend of the court", "endorses", "endorsement",
    "supports", "supports rules", "supports legislation", "issues statement", "issues guidance", "regional convening", "reminds consumers", "warns consumers", "highlights", "releases report", "releases bulletin",
    "releases data", "annual report", "celebrating", "celebrates", "appointed", "appointment", "grant announcement", "volunteers", "sponsored bill", "signed into law", "opens investigation",
    "investigating officer", "investigating shooting", "awareness month", "heritage month", "comment letter", "testimony before", "urges", "calls on", "applauds", "commends", "welcomes",
    "encourages students", "high school students", "teen ambassador", "conceal carry", "concealed carry", "peace officer", "fallen officer", "gun buyback", "open carry", "legal explainer", "legal analysis",
    "provides update", "provides statement", "solicitor general", "free help available", "free help for", "plugs free", "one step closer", "animal cruelty", "cruelty to animals", "releases footage",
    "releases video", "body cam", "body camera",
]
#: Headlines that are no enforcement whatever the body says.
OTHER_HEADLINES = [
    r"issues?\s+(?:a\s+)?statement\s+(?:on|regarding|following|in\s+response)",
    r"(?:sponsored|authored)\s+bill",
    r"signed\s+into\s+law",
    r"releases?\s+(?:updated\s+)?(?:guide|report|bulletin|data)",
    r"warns?\s+consumers",
    r"reminds?\s+(?:consumers|californians|immigrants)",
    r"investigating\s+(?:officer|shooting)",
    r"announces?\s+appointment",
    r"(?:urges?|calls?\s+on|call\s+on)\s+",
    r"(?:applauds?|commends?|welcomes?|praises?)\s+",
    r"(?:comment|letter)\s+(?:to|on|regarding)\s+",
    r"(?:heritage|awareness)\s+month",
    r"(?:honors?|mourns?|remembers?|salutes?)\s+(?:fallen|slain)",
    r"statement\s+on\s+(?:passing|death|fallen|shooting)",
    r"(?:gun\s+buyback|guns?\s+turned\s+in)",
    r"(?:issues?\s+(?:legal\s+)?(?:opinion|advisory))\b",
    r"encourages?\s+(?:students|residents|high\s+school)",
    r"announces?\s+(?:appointment|tour|town\s+hall)",
    r"(?:kicks?\s+off|launches?)\s+(?:year|program|tour)",
    r"warns?\s+(?:against|about|of\s+(?:potential|scam|fraud))\b",
    r"warns?\s+(?:new\s+yorkers|texans|californians|ohioans|oregonians|residents)\b",
    r"(?:statement\s+(?:from|on)\b)",
    r"(?:issues?|releases?|publishes?)\s+(?:an?\s+)?open\s+letter\b",
    r"(?:joins?|signs?|submits?|files?)\s+(?:an?\s+)?(?:amicus|friend.of.the.court)\s+brief",
    r"(?:leads?|joins?)\s+(?:[\w\s-]+)?(?:effort|brief|letter)\s+(?:supporting|opposing|urging|calling)",
    r"(?:condemns?|vows?\s+to|pledges?\s+to)\s+",
    r"(?:holds?\s+(?:kickoff|meeting|convening|summit))\b",
    r"(?:seeks?\s+(?:students|volunteers|applicants|high.school))\b",
    r"(?:invites?\s+(?:students|ohio|high.school))\b",
    r"(?:application\s+deadline|apply\s+for)\b",
    r"(?:remembering|in\s+memory\s+of|legacy\s+of)\b",
    r"(?:trump|biden)\s+administration.{0,20}s?\s+(?:illegal|unlawful|threatens?|attempt)",
    r"(?:to\s+consumers?:)",
    r"(?:issues?\s+(?:warning|legal\s+alert))\b",
    r"(?:focuses?\s+on|questions?$|has\s+questions$)",
    r"(?:study\s+shows|did\s+not\s+drive|change\s+in\s+(?:concealed|carry|law))\b",
    r"(?:releases?\s+(?:yellow\s+book|annual|20\d{2}))",
    r"(?:age.progression|missing\s+(?:cleveland|man|woman|person|child)|identity\s+restored)",
    r"(?:peace\s+officers?\s+(?:memorial|basic\s+training|ceremony))\b",
    r"(?:concealed?\s+carry\s+report|conceal\s+carry\s+report)\b",
    r"(?:provides?\s+(?:legal\s+)?(?:analysis|update|explainer))\b",
    r"(?:announces?\s+pick\s+for|new\s+(?:solicitor|deputy|chief))\b",
    r"(?:preserves?\s+(?:its|california|ability))\b",
    r"consumer\s+alert",
    r"(?:alerts?|reminds?)\s+(?:businesses|city\s+attorneys|consumers|residents|new\s+yorkers|texans|californians)",
    r"(?:issues?|provides?|releases?)\s+(?:[\w\s]+)?(?:guidance|revised\s+(?:legal\s+)?guidance)",
    r"(?:leads?|joins?|co-?leads?)\s+(?:[\w\s-]+)?(?:coalition|effort|brief)\s+(?:[\w\s]+)?(?:support|oppos|urg|call|defend)",
    r"(?:names?\s+new|promotes?\s+|establishes?\s+)",
    r"(?:know\s+your\s+rights|remains?\s+in\s+effect|certif(?:y|ies)\s+(?:\d+\s+)?(?:initiative|petition))",
    r"^bills?\s+(?:to|creates?|establishes?|provides?|would|authoriz|requires?)\b",
    r"(?:to\s+(?:congress|u\.?s\.?\s+supreme\s+court):)",
    r"stands?\s+with\b",
    r"(?:vote\s+early|voter\s+protection|election\s+integrity\s+law)",
    r"(?:remains?\s+illegal\s+to|it\s+remains?\s+illegal)",
    r"responds?\s+to\s+(?:court|supreme|u\.?s\.?)",
    r"(?:dismantl|would\s+cause\s+irreparable)\b",
    r"puts?\s+(?:[\w\s]+)?on\s+notice\b",
    r"(?:one\s+step\s+closer|benefits?\s+(?:are|is)\s+(?:one|coming|on\s+the\s+way))\b",
    r"(?:court\s+filings?\s+mean|filings?\s+(?:bring|move|mean))\b",
    r"plugs?\s+(?:free|resources?)\b",
    r"releases?\s+(?:footage|video|body\s*cam)\s+(?:from|of)\s+(?:investigation|incident)",
    r"investigation\s+into\s+(?:the\s+)?(?:death|killing|shooting)\s+of\b",
    r"\bbills?\s+(?:creates?|would|establishes?|provides?|requires?|authoriz)",
    r"(?:free\s+help|plugs?\s+free|free\s+(?:resource|assistance|service|program))\b",
    r"(?:help\s+(?:available|for)\s+(?:struggling|homeowners|consumers|residents))\b",
    r"\b(?:animal\s+cruelty|animal\s+abuse|felony\s+(?:animal|cruelty|criminal)|cruelty\s+to\s+animals)\b",
    r"\b(?:felony|misdemeanor)\s+(?:charge|count)s?\s+(?:against|for|in|filed)\b",
    r"\b(?:murder|homicide|manslaughter|cold\s+case|serial\s+(?:killer|murder))\b",
    r"highlights?\s+(?:\d+|wins|accomplishments|results)\b",
    r"\b(?:referendum|ballot\s+measure|proposition\s+\d+|initiative\s+\d+)\b",
    r"title\s+and\s+summary\s+(?:language\s+)?certified",
    r"(?:passing\s+of|death\s+of|mourns?\s+(?:loss|the\s+passing)|in\s+memory\s+of)\b",
    r"(?:guilty|convicted|sentenced)\s+(?:of\s+|in\s+)?(?:murder|manslaughter|homicide|assault|kidnapping)",
    r"(?:murder|manslaughter|homicide)\s+(?:case|trial|conviction|charge)",
]

# --- money that is no settlement, in the 80 characters around an amount ------------------
OTHER_MONEY = [
    r"grant", r"funding", r"appropriat", r"budget", r"federal\s+aid", r"allocat", r"CDC", r"HHS", r"FEMA", r"federal\s+funds?", r"tax\s+(?:relief|cut|credit|revenue)",
    r"government\s+(?:funding|spending)", r"legislative", r"executive\s+order", r"stimulus", r"infrastructure\s+(?:funding|investment)", r"seiz(?:ed?|ure|ing)", r"fentanyl", r"trafficking", r"narcotic", r"border",
    r"gross\s+domestic", r"GDP", r"economy", r"economic\s+(?:impact|growth|loss)", r"revenue", r"sales", r"market\s+(?:cap|value)", r"stock", r"share\s+price", r"annual\s+(?:revenue|budget|sales)", r"industry", r"sector",
    r"student\s+loan", r"debt\s+(?:forgiveness|cancellation|discharge)", r"would\s+(?:cause|cost|harm|result|lose|destroy|eliminate)", r"irreparable", r"dismantl", r"CFPB", r"Consumer\s+Financial\s+Protection\s+Bureau",
    r"proposed\s+(?:rule|regulation|legislation|bill)", r"wage", r"per\s+(?:hour|day|week|month|year)", r"hourly\s+rate", r"minimum\s+wage", r"initiative", r"ballot\s+measure", r"proposition", r"I-\d+",
    r"exposed?\s+to", r"risk\s+of", r"face(?:s|d)?\s+(?:up\s+to)", r"could\s+face", r"maximum\s+(?:penalty|fine)\s+of", r"up\s+to\s+\$",
]

# --- action types: alternatives of each family, families in order of precedence ----------
ACTION_TYPES = {
    "consent_decree": [r"consent\s+(?:decree|order|agreement)"],
    "assurance_of_discontinuance": [r"assurance\s+of\s+(?:discontinuance|voluntary\s+compliance)", r"AOD"],
    "settlement": [
        r"settl(?:ed|ement|ements|es|ing)", r"agrees?\s+to\s+pay", r"agreed\s+to\s+pay", r"reaches?\s+(?:an?\s+)?agreement", r"reached\s+(?:an?\s+)?agreement", r"resolves?\s+(?:claims?|charges?|allegations?|dispute|investigation|case)", r"resolved",
        r"pays?\s+fine", r"paid\s+fine", r"pays?\s+penalty", r"consent\s+judgment", r"recover(?:s|ed|y|ies)", r"secures?\s+(?:more\s+than\s+|over\s+|nearly\s+|approximately\s+)?\$", r"obtains?\s+\$", r"wins?\s+\$",
        r"secures?\s+(?:[\w$.,]+\s+){0,6}(?:agreement|settlement|debt\s+relief)", r"(?:ends?|ending)\s+(?:harmful|illegal|unlawful|deceptive)\s+\w+\s+practices?", r"delivers?\s+\$", r"restitution\s+(?:in|on)\s+the", r"(?:on\s+the\s+way|in\s+the\s+mail)\s+to",
        r"agrees?\s+to\s+(?:remove|stop|halt|cease|reform|change|end|eliminate|address|provide|destroy|surrender)", r"distributes?\s+(?:over\s+)?\$",
    ],
    "judgment": [
        r"judgments?", r"verdict", r"sentenced", r"sentencing", r"convicted", r"conviction", r"convictions?\s+of", r"pleads?\s+guilty", r"pled\s+guilty", r"guilty\s+plea", r"guilty\s+verdict", r"found\s+(?:guilty|liable)", r"court\s+orders?\b", r"jury\s+(?:verdict|finds?)",
        r"(?:secures?|wins?)\s+(?:[\w]+\s+){0,3}(?:victory|ruling|win|review|decision)", r"surrenders?\s+(?:\w+\s+)?license", r"permanently\s+(?:shuts?|bars?|bans?|closes?)", r"arrested", r"(?:\d+\s+)?arrests?\s+(?:for|in|of|made)",
        r"court\s+(?:declares?|rules?|upholds?|affirms?|denies|strikes?\s+down)", r"judge\s+(?:dismisses?|rules?|orders?|blocks?|upholds?|strikes?)", r"(?:appellate|appeals?\s+court)\s+(?:decision|ruling|upholds?|affirms?)", r"blocks?\s+(?:[\w]+\s*'?s?\s+){0,3}(?:attempt|motion|request|bid)",
    ],
    "injunction": [
        r"injunction", r"restraining\s+order", r"TROs?\b", r"cease\s+and\s+desist", r"banned?\s+from", r"bans?\s+(?:[\w]+\s+){1,5}from", r"temporarily\s+blocked", r"preliminary\s+injunction", r"permanent\s+injunction", r"shut\s+down", r"shuts?\s+down",
        r"ordered?\s+to\s+(?:halt|stop|cease)", r"orders?\s+\w+\s+to\s+(?:halt|stop|cease)", r"demands?\s+(?:[\w]+\s+){0,4}(?:halt|stop|cease|immediate\s+halt)",
    ],
    "lawsuit_filed": [
        r"(?:files?|filed)\s+(?:[\w]+\s+){0,5}(?:lawsuit|complaint|action|suit|litigation|charges?|petition)", r"announces?\s+(?:[\w]+\s+){0,3}(?:lawsuit|complaint|suit|litigation|charges?\s+against|indictment)", r"brings?\s+(?:a\s+)?(?:action|charges?|suit|complaint)",
        r"(?:takes?|took)\s+(?:legal\s+)?action\s+(?:against|to|in\s+)", r"charged?\s+with", r"facing\s+(?:[\w]+\s+){0,3}charges", r"charges?\s+(?:[\w]+\s+){0,5}(?:in\s+connection|defendant|suspect|individual)", r"indicts?", r"indicted", r"indictment",
        r"(?:co-?leads?|leads?|joins?)\s+(?:[\w-]+\s+){0,4}(?:lawsuit|litigation|suit|challenge)", r"sues?", r"sued", r"suing", r"(?:files?|launches?|announces?|commences?)\s+(?:[\w]+\s+){0,3}investigation", r"investigates?\b",
        r"(?:seeks?\s+to\s+(?:lead|co-?lead)\s+[\w\s-]*?(?:lawsuit|litigation|suit))", r"appeals?\s+(?:ruling|decision|order)", r"cracks?\s+down", r"crackdown", r"(?:enforcement\s+action)\s+against", r"pleads?\s+not\s+guilty", r"(?:expands?|updates?)\s+(?:[\w]+\s+){0,3}(?:investigation|lawsuit|suit)",
    ],
}
MULTISTATE = [
    r"\bmultistate\b", r"\bcoalition\s+of\s+(?:\d+\s+)?(?:state|attorney)", r"\b(\d+)\s+state(?:s)?\s+(?:attorneys?\s+general|AGs?)\b", r"\b(?:bipartisan|nationwide)\s+(?:coalition|group|states?)\b", r"\bjoined?\s+(?:by\s+)?\d+\s+(?:other\s+)?state",
    r"attorneys?\s+general\s+of\s+(?:\w+(?:\s+\w+)?,?\s+){3,}", r"\bstates?\s+negotiating\s+committee\b", r"\bjoining\s+attorney\s+general\b(?s:.*)\battorneys?\s+general\s+of\b",
]

# --- laws ---------------------------------------------------------------------------------
NAMED_LAWS = [
    r"Sherman\s+Act", r"Clayton\s+Act", r"FTC\s+Act", r"False\s+Claims\s+Act", "CCPA", "COPPA", "TCPA", "CAN-SPAM", "HIPAA", "FCRA", "RICO", "UDAP", "ADA", "FLSA", "OSHA", "ECOA", "TILA", "RESPA", "FDCPA", r"Unfair\s+Competition\s+Laws?", "UCL", "CLRA",
    r"Telephone\s+Consumer\s+Protection\s+Act", r"Telemarketing\s+Sales\s+Rule", r"Truth\s+in\s+Caller\s+ID\s+Act", r"Truth\s+in\s+Lending\s+Act", r"Anti-?Kickback\s+Statute", r"Stark\s+Law", r"Unclaimed\s+Property\s+Law", r"Clean\s+Air\s+Act", r"Clean\s+Water\s+Act",
    r"Fair\s+Housing\s+Act", r"Fair\s+Credit\s+Reporting\s+Act", r"Fair\s+Debt\s+Collection\s+Practices\s+Act", r"Dodd-?Frank\s+Act", r"Consumer\s+Legal\s+Remedies\s+Act", r"Consumer\s+Fraud\s+Act", r"Elder\s+Abuse\s+Act", r"Real\s+Estate\s+Settlement\s+Procedures\s+Act",
    r"Equal\s+Credit\s+Opportunity\s+Act", r"Racketeer\s+Influenced\s+and\s+Corrupt\s+Organizations\s+Act",
]
STATUTES = [
    r"(?:California\s+)?(\w[\w\s]+?)\s+Code\s+(?:section|§§?)\s*([\d.]+(?:\s*(?:et\s+seq|through)\s*[\d.]*)?)",
    r"(\d+)\s+U\.?S\.?C\.?\s*§?\s*([\d]+(?:\([a-z]\))?)",
    r"\b(" + "|".join(NAMED_LAWS) + r")\b",
    r"(?:in\s+violation\s+of|violat(?:ed|ing))\s+(?:the\s+|state\s+)?(?:[\w\s,]+?\s+)((?:Act|Laws?|Code|Statute|Rule|Regulation)s?)\b",
]
FEDERAL_LAW = ["u.s.c.", "usc", "federal", "ftc", "sherman", "clayton", "can-spam", "hipaa", "fcra", "coppa", "tcpa", "rico", "dodd-frank", "respa", "tila", "ecoa", "ada", "flsa", "osha", "stark", "anti-kickback", "clean air", "clean water", "fair housing act", "fdcpa", "telemarketing sales rule", "truth in caller", "truth in lending"]
STATE_LAW = ["california", "business and professions", "civil code", "health and safety", "penal code", "ccpa", "ucl", "unfair competition", "clra", "consumer legal remedies", "unclaimed property", "udap", "consumer fraud act", "consumer protection act"]
#: Common names; the first that fits counts.
LAW_NAMES = [
    (r"ccpa|consumer privacy act", "CCPA"), (r"coppa|children.s online privacy", "COPPA"), (r"tcpa|telephone consumer protection", "TCPA"), (r"hipaa|health insurance portability", "HIPAA"), (r"fcra|fair credit reporting", "FCRA"), (r"can.spam", "CAN-SPAM"),
    (r"clean air act", "Clean Air Act"), (r"clean water act", "Clean Water Act"), (r"\brico\b|racketeer influenced", "RICO"), (r"dodd.frank", "Dodd-Frank Act"), (r"respa|real estate settlement", "RESPA"), (r"tila|truth in lending", "TILA"),
    (r"ecoa|equal credit opportunity", "ECOA"), (r"\bada\b|americans with disabilities", "ADA"), (r"flsa|fair labor standards", "FLSA"), (r"osha|occupational safety", "OSHA"), (r"stark law", "Stark Law"), (r"anti.kickback statute", "Anti-Kickback Statute"),
    (r"ftc act|federal trade commission act", "FTC Act"), (r"sherman act|sherman\s", "Sherman Act"), (r"clayton act|clayton\s", "Clayton Act"), (r"false claims act|false claims", "False Claims Act"), (r"telemarketing sales rule", "Telemarketing Sales Rule"),
    (r"truth in caller", "Truth in Caller ID Act"), (r"fair housing act", "Fair Housing Act"), (r"fair debt collection", "FDCPA"), (r"elder abuse", "Elder Abuse Act"), (r"unfair\s+(?:and\s+)?deceptive.*(?:act|practices)|udap", "UDAP"), (r"consumer fraud act", "Consumer Fraud Act"),
    (r"business and professions code\s+(?:section\s+)?(?:§§?\s*)?172", "UCL"), (r"ucl|unfair competition law", "UCL"), (r"civil code\s+(?:section\s+)?(?:§§?\s*)?175", "CLRA"), (r"consumers?\s+legal\s+remedies", "CLRA"), (r"unclaimed property", "Unclaimed Property Law"),
]

# --- parties ------------------------------------------------------------------------------
#: Of a headline each pattern gives its first match.
HEADLINE_PARTIES = [
    r"(?:sues?|lawsuit\s+against|action\s+against)\s+([\w\s,.&'-]+?)(?:\s+(?:for|over|in|regarding|alleging|with))",
    r"settlement\s+with\s+([\w\s,.&'-]+?)(?:\s+(?:for|over|in|regarding|resolving|to)|$)",
    r"\bcharges?\s+([\w\s,.&'-]{2,50}?)\s+(?:with|over|for)\b",
    r"(?:from)\s+([\w\s,.&'-]+?)(?:\s+(?:for|over|in|regarding|fueling|alleging))",
    r"(?:charges?\s+against|against)\s+([\w\s,.&'-]+?)(?:\s*,\s*|\s+(?:for|over|in|regarding|benefiting|resulting)|$)",
    r"(?:with)\s+([\w\s,.&'-]+?)(?:\s*,\s*|\s+(?:for|over|in|regarding|resolving|to)|$)",
    r"\bv\.?\s+([\w\s,.&'-]+?)(?:\s*$|\s*[,;]|\s+(?:for|over|in|regarding|that))",
    r"(?:^|:\s*)([\w\s,.&'-]+?)\s+(?:Must|Agrees?\s+to|to|Will|Ordered\s+to)\s+Pay\b",
    r"(?:investigation\s+(?:into|of))\s+([\w\s,.&'-]+?)(?:\s+(?:for|over|regarding|alleging|results|leads|reveals)|[,;]|$)",
    r"(?:stops?|halts?|shuts?\s+down)\s+([\w\s,.&'-]+?)(?:\s*(?:'s)?\s+(?:for|over|from|illegal|unlawful|deceptive))",
    r"(?:secures?|recovers?|obtains?)\s+[\$\d][\$\d\w\s,.]*?\s+from\s+([\w\s,.&'-]+?)(?:\s+(?:for|over|in|to)|[,;]|$)",
    r"(?:^|:\s*)([\w\s,.&'-]+?)\s+(?:Ordered|Required|Directed)\s+to\b",
]
#: Of a body's opening each pattern gives all its matches.
BODY_PARTIES = [
    r"(?:defendant|respondent)s?\s+([\w\s,.&'-]{3,60}?)(?:\s*[,.])",
    r"(?:filed\s+(?:a\s+)?(?:lawsuit|complaint|action)\s+against)\s+([\w\s,.&'-]{3,60}?)(?:\s*[,.]|\s+(?:for|over|in|alleging))",
    r"settlement\s+with\s+([\w\s,.&'-]{3,80}?)(?:\s*[,.])",
    r"(?:against)\s+([\w\s,.&'-]{3,60}?)(?:\s*,\s*(?:a|an|the|who|which)|\s+(?:for|over|in|regarding|alleging))",
    r"(?:settlement\s+with|against|lawsuit\s+against)\s+([\w\s.&'-]{3,60}?)\s*\(([A-Z]{2,10})\)",
    r"(?:announced\s+(?:a\s+)?(?:lawsuit|complaint|action|suit)\s+against)\s+([\w\s,.&'-]{3,60}?)(?:\s+(?:for|over|in|regarding|alleging))",
    r"(?:ringleaders?|leaders?|organizers?)\s+(?:of\s+the\s+scheme\s*,?\s*)([\w\s,.&'-]{5,80}?)(?:\s*,\s*(?:were|was)\s+(?:sentenced|convicted))",
    r"\bsued\s+([\w\s,.&'-]{3,60}?)(?:\s*[,.]|\s+(?:for|over|in|alleging|under))",
    r"charges?\s+against\s+([\w\s,.&'-]{3,60}?)(?:\s*[,.]|\s+(?:for|over|in|alleging|relating))",
    r"(?:a\s+)?(?:lawsuit|action|suit|complaint)\s+against\s+([\w\s,.&'-]{3,60}?)(?:\s*[,.]|\s+(?:for|over|in|alleging))",
    r"(?:against|with|sued|suing|charging)\s+([\w\s,.&'-]{3,50}?(?:Inc\.?|Corp\.?|LLC|L\.?L\.?C\.?|Ltd\.?|L\.?P\.?|Company|Corporation))",
    r"investigation\s+(?:of|into)\s+([\w\s,.&'-]{3,60}?)(?:\s*[,.]|\s+(?:for|over|in|regarding|related))",
]
#: Names that hold an "and".
TOGETHER = [
    r"Food\s+and\s+Drug", r"Arms?\s+and\s+Ammunition", r"Alcohol,?\s+Tobacco,?\s+(?:Firearms?\s+)?and\s+", r"Johnson\s+and\s+Johnson", r"Procter\s+and\s+Gamble", r"Ernst\s+and\s+Young", r"Standard\s+and\s+Poor", r"Bath\s+and\s+Body", r"Harley.Davidson",
    r"Bed\s+Bath\s+and\s+Beyond", r"Barnes\s+and\s+Noble", r"Simon\s+and\s+Schuster", r"Merrill\s+Lynch.*and", r"cease\s+and\s+desist", r"assault\s+and\s+battery",
]
#: What makes a captured phrase a fragment and no name.
PARTY_FRAGMENTS = [
    r"\bthat\s+(?:would|could|should|will|may|might|did)\b", r"^[^,]*,\s*(?:largest|biggest|first|major|historic|record|significant)\b", r"\bfor\s+(?:deceiving|misleading|defrauding|violating|failing|scamming|harming|exploiting|overcharging|deceptive|illegal|unlawful|false|unfair)",
    r"^[A-Z]\w+(?:\s+[A-Z]\w+)?\s+(?:man|woman|men|women|business|resident|couple|family)$", r"-$", r"^(?:e-?cigarette|cryptocurrency|crypto|vaping|mortgage|tobacco)\s*(?:platform|companies|company|firm|firms|exchange|exchanges|lender|lenders|broker|brokers|servicer|servicers)?s?(?:\s|,|$)",
]

# --- canonical names ------------------------------------------------------------------------
TRAILING = r"\s*(?:(?:claiming|alleging|asserting|accusing|contending)\s+(?:that|the)|(?:regarding|over\s+the|for\s+(?:violating|illegally|deceptive|failing))|(?:is\s+scheduled|has\s+now\s+been|today|to\s+hold\s+the)|(?:secured\s+by|resulting|the\s+parent|to\s+(?:inc|move))|(?:,?\s+with\s+a\s+u\.s\.)|(?:\.\s+(?:Filed|The\s+states|The\s+money))).*$"
LEADING = r"^(?:technology\s+giant|internet\s+giant|pharmaceutical\s+(?:giant|manufacturer)|opioid\s+manufacturer|oxycontin\s+maker|drug\s+manufacturers?|e-?cigarette\s+(?:maker|company)|electronic\s+cigarette\s+maker,?\s*)\s*"
SUFFIX = r",?\s*\b(?:Inc\.?|Incorporated|Corp\.?|Corporation|LLC|L\.L\.C\.?|Ltd\.?|Limited|L\.P\.?|LP|LLP|L\.L\.P\.?|Co\.?|Company|PLC|P\.L\.C\.?|NA|N\.A\.?|et\s+al\.?|d/b/a\s+\S+)\s*$"
NO_NAMES = (
    "a an the his her its that this them they it he she we us me my our your their who what which where when how there here all any new one two three four five six each than then also just like over only many some such more most very much well"
    " back into with from about will or if so no not but yet do can may shall be been being am is are was were have has had having get got did would could should must make made take took give gave keep kept let say said use run ran"
    " business company nation office help complete election investigation discrimination travel pharmaceutical operating major other former another several act law court state federal child children people person seller"
    " notice report order plan claim relief charge grant rule damage risk abuse penalty complaint violation statute settlement enforcement authority oversight guidance protection measure effort failure impact safety access matter issue harm threat concern policy"
    " mortgage cryptocurrency e-cigarette companies funding centers patients owners"
).split() + ["real estate"]
#: The first is matched with regard to case.
NO_NAME_PATTERNS = [
    r"^(?-i:[a-z])(?!bay|phone|pod|tunes)", r"^death\s+of\b", r"(?:attorney.?s?\s+general|attorneys\s+general|district\s+attorney)", r"(?:trump|biden|obama)\s+(?:administration|era)", r"^(?:president\s+(?:trump|biden|donald))\b",
    r"(?:department\s+of|secretary\s+of|u\.?s\.?\s+(?:supreme|district|department))", r"^\d+\s+(?:state\s+)?attorneys?\s+general\b", r"^(?:drug|highway|transit|veterans?)\s+administration\b", r"^homeland\s+security\b", r"\b(?:commission|bureau|department)\s*$",
    r"\b(?:women|disabilities|privacy|recovery|clean\s+(?:air|water))\s+act\b", r"(?:^|\b)(?:drug|opioid|pharmaceutical|tobacco|e-?cigarette|generic)\s+(?:maker|manufacturer|distributor|company|companies)s?\b",
    r"^(?:two|three|four|five|six|seven|eight|ten)\s+(?!west\b|guys\b|rivers?\b|flags?\b|star\b|point\b)", r"\bfood\s+(?:&|and)\s+drug\s+administration\b", r"^settlement\s+with\b", r"\bpolice\s+department\b", r"^press\s+release\b", r"^acting\s+(?:tax|attorney|district|commissioner)",
    r"^\d+\s+(?:states?|individuals?|defendants?|companies|businesses|officers?|suspects?|felonies|producers?|pharmacies|drug\s+makers|other\s+sta)",
    r"\b(?:claiming|alleging|saying|stating|arguing|asserting|accusing|contending|opposing|demanding|requesting|attempting|resulting|announcing|filed|scheduled|according|beginning|providing)\b",
    r"\bto\s+(?:protect|block|stop|prevent|hold|ensure|support|help|combat|fight|halt|reform|end|strike|address|require|prohibit|investigate|crack|avoid|enforce)\b", r"^(?:his|her|its|their)\s+", r"^consumer\s+alert\b", r"^20\d{2}\s+(?:capital|health|annual|cost|data)",
    r",\s+(?:the|a|an|with|for|that|which|who|in|on|to|its|his|her|claiming|alleging|accusing|asserting|but|and\s+the)\s", r"amicus\s+brief|brief\s+joined\s+by", r"(?:battleground|on\s+behalf\s+of)\s+", r"-based\s+company\b", r"\blargest\s+\w+\s+settlement\b",
    r"^(?:unlawfully|illegally|fraudulently|knowingly|willfully)\s+", r"^consumers?\s+(?:is|are|was|were|has|have)\b", r"^over\s+(?:hud|the|a|an|its)\b", r"^(?:trafficker|lender|borrower|manufacturer|distributor|retailer|contractor|employer|provider|operator|vendor|dealer|broker)s?$",
    r"^[A-Z]\w+(?:\s+[A-Z]\w+)?\s+(?:man|woman|men|women|business|resident|couple|family)$", r"\bfor\s+(?:deceiving|misleading|defrauding|violating|failing|scamming|harming|exploiting|overcharging|deceptive|illegal|unlawful|false|unfair)", r"-\s*$",
    r"^(?:e-?cigarette|cryptocurrency|crypto|vaping|mortgage|tobacco)\s+(?:platform|companies|company|firm|firms|exchange|exchanges|lender|lenders|broker|brokers|servicer|servicers)s?(?:\s|,|$)",
    r"^(?:during|before|after|between|within|toward|upon)\s+(?:the|a|an|this|that)$", r"^(?:owner|founder|ceo|president|chairman)\s+\w+\s+for\b",
]

# --- display ----------------------------------------------------------------------------------
CATEGORY_LABELS = {
    "consumer_protection": "Consumer Protection", "data_privacy": "Data Privacy & Security", "antitrust": "Antitrust", "healthcare": "Healthcare Fraud", "environmental": "Environmental", "securities": "Securities Fraud", "housing_lending": "Housing & Lending",
    "employment": "Wage & Employment", "telecommunications": "Telecommunications", "charitable": "Charitable / Nonprofit", "tobacco_vaping": "Tobacco & Vaping", "tech_platform": "Tech Platform Accountability",
}
TYPE_LABELS = {"settlement": "Settlement", "lawsuit_filed": "Lawsuit Filed", "judgment": "Judgment", "injunction": "Injunction", "consent_decree": "Consent Decree", "assurance_of_discontinuance": "Assurance of Discontinuance"}
HIDDEN_NAMES = [
    "mortgage", "mortgage servicer", "e-cigarette", "cryptocurrency", "companies", "funding", "centers", "owners", "patients", "consumers is", "federal government", "telecommunications", "statement", "biotechnology", "national", "student", "software", "services",
    "territories", "construction", "marketing", "providers", "health", "firm", "oil", "opioid", "tips", "colleges", "cryptocurrency platform", "cryptocurrency trading", "cryptocurrency markets", "another cryptocurrency", "during the", "everett man", "seattle business",
    "huntington beach sinc", "paul means", "blayne m", "blayne m. perez", "federal way discount guns", "ag ferguson", "ag yost", "ag paxton", "ag bonta", "ag james", "ag healey", "ag campbell", "ag rayfield",
]
HIDDEN_PATTERNS = [
    r"^cryptocurrency\b", r"^crypto\s+firm\b", r"^former\s+ceo\s+of\b", r"\bfor\s+deceiving\b", r"\bman$", r"\bbusiness$", r"\bwoman$", r"^(?:two|three|four|five|six|seven|eight|nine|ten)\s+", r"^(?:a|an|the)\s+", r"\bowner\b.*\bfor\b", r"^maker\s+of\b", r"^\d+\s+corporate\b",
    r"^joint\s+statement\b", r"^multistate\b", r"^illegally\b", r"^unlawfully\b",
]
MERGED_NAMES = {"Juul Labs": "Juul", "ByteDance": "TikTok", "Tik Tok": "TikTok", "Sacklers": "Sackler Family", "Purdue": "Purdue Pharma", "Marriott International": "Marriott"}
NO_SETTLEMENT_HEADLINES = [
    r"\bbill\s+creates\b", r"\blegislat", r"\bdismantling\s+cfpb\b", r"\bfree\s+help\s+available\b", r"\bcheck\s+the\s+mail\b", r"\bplugs\s+free\s+help\b", r"\bhomeowners?\s+(?:can|should|may)\b", r"\bconsumer\s+(?:tips?|alert)\b", r"\bone\s+step\s+closer\b", r"\bbenefits\s+are\s+one\s+step\b",
    r"\bproviding\s+huge\s+benefits\b", r"\bstruggling\b.*\bhomeowners?\b", r"\bcourt\s+decision\s+allowing\s+states\s+to\s+participate\b", r"^(?:june|july|august|september|october|november|december|january|february|march|april|may)\s+\d", r"^olympia\s*[-–—]", r"^the\s+money\s+is\b",
    r"^\w+\s*[-–—]\s*\w+\s+\d{1,2},\s*\d{4}", r"\bconsumers?\s+will\s+benefit\b",
]
NO_FEED_HEADLINES = [
    r"\bany\s+federal\s+legislation\b", r"\btransparency\s+and\s+accountability\b", r"\bmust\s+allow\s+states\b", r"\bfoundation\s+of\s+good\s+law\b", r"\bstatement\s+on\b", r"\bissues?\s+statement\b", r"\bconsumer\s+alert\b", r"\bconsumer\s+tips?\b", r"\burges?\b",
    r"\boppos(?:es?|ing)\s+(?:trump|biden|federal)\b", r"^press\s*release\s*(?:ag|attorney)\b", r"\bplead(?:ed|s)?\s+guilty\s+in\s+(?:mahoning|valley).*trafficking\b", r"\blegal\s+observation\s+project\b", r"\bto\s+monitor\s+federal\b",
]
CATEGORY_ORDER = ["data_privacy", "antitrust", "environmental", "healthcare", "tech_platform", "securities", "tobacco_vaping", "employment", "housing_lending", "telecommunications", "charitable", "consumer_protection", "other"]


def any_of(patterns: list[str]) -> str:
    """One pattern for all, without regard to case."""
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
