"""Word lists, score bands and weights as plain data.

Every operator takes its markers from a ``dict[str, list[str]]`` so that the
same job runs on any corpus: pass ``LEXICON | {"abuse_words": [...]}``.
"""

# Everything in this file is data that results depend on.

STANCES = [
    "SUPPORTIVE_DEFENSE", "CONSTRUCTIVE_CRITICISM", "NEUTRAL_ANALYSIS", "BALANCED_DEBATE",
    "DISMISSIVE_COMPLAINT", "DIRECT_ATTACK", "SARCASTIC_CRITICISM", "MIXED_STANCE",
]
PRIMARY_STANCES = [
    "SUPPORTIVE_DEFENSE", "DIRECT_CRITICISM", "SARCASTIC_ATTACK", "NEUTRAL_COMMENTARY", "MIXED_OR_AMBIGUOUS",
]
STYLE_TAGS = ["DIRECT", "SARCASTIC", "HYPERBOLIC", "RHETORICAL", "QUOTED", "REPORTED", "IMPLIED", "CONVERSATIONAL"]
WRITER_TYPES = ["Passionate Fan", "Analyst", "Storyteller", "Debater", "All-Rounder"]
WRITING_STYLES = ["analytical", "balanced", "emotional", "dismissive", "attack_based", "unknown"]
TOPICS = [
    "batting", "bowling", "fielding", "captaincy", "strategy", "team_performance",
    "player_comparison", "tournament", "general",
]
VISIBILITIES = ["public", "private", "invite_only"]
NON_BOWLER_WICKETS = [
    "run out", "retired hurt", "retired out", "obstructing the field", "handled the ball", "timed out",
]
SARCASM_THRESHOLD = 0.35

LEXICON: dict[str, list[str]] = {
    # --- stance -----------------------------------------------------------
    "supportive": [
        "defend player", "unfair criticism", "context matters", "different scenario", "evolved player",
        "mentally stronger", "future potential", "needs confidence", "team did not support",
    ],
    "constructive": [
        "should have used", "could have worked better", "instead of", "depending on conditions",
        "role clarity", "selection pattern", "team balance",
    ],
    "complaint": [
        "same mistake again", "nothing changes", "always happens", "waste selection", "management never learns",
        "again and again", "same confusion", "repeating mistakes", "frustrating to watch", "ignored repeatedly",
        "again and again ignored", "same issue again", "no clear plan", "no long-term plan", "repeated confusion",
    ],
    "frustration": [
        "again and again", "same confusion", "repeating mistakes", "frustrating to watch", "ignored repeatedly",
        "again and again ignored", "same issue again", "same mistake again", "no clear plan", "no long-term plan",
        "repeated confusion",
    ],
    "attack": [
        "pathetic", "useless", "slow player", "bad player", "overrated", "should not play",
        "clearly not performing", "management ignoring problems", "keeps selecting players who are not performing",
        "issues are being ignored", "problems are being ignored", "obvious issues ignored", "selectors ignoring",
        "management ignoring", "selection mistakes continue", "selection problems continue",
    ],
    "selection_attack": [
        "clearly not performing", "management ignoring problems", "keeps selecting players who are not performing",
        "issues are being ignored", "problems are being ignored", "obvious issues ignored", "selectors ignoring",
        "management ignoring", "selection mistakes continue", "selection problems continue",
    ],
    "suggestion": [
        "should", "could", "needs to", "need to", "must", "recommend", "better to", "improve", "fix", "instead of",
    ],
    "debate_balance": ["on one hand", "on the other hand", "some believe", "others argue", "depends on"],
    "contrast": ["but", "however", "instead", "rather", "actually", "irrelevant", "unfair", "incorrect"],
    "discourse_extra": ["because", "as a result", "this means"],
    "directness": ["must", "clearly", "obvious", "definitely"],
    "certainty": ["clearly", "definitely", "obviously", "surely", "always", "never"],
    "neutrality": ["analysts", "report", "according to", "some believe", "others believe"],
    "stance_reasoning": [
        "because", "therefore", "however", "while", "although", "if", "then", "which means", "as a result",
        "instead of", "rather than",
    ],
    "sarcasm_metaphors": [
        "masterclass in suspense", "meditation retreat", "rare art", "optional feature", "geological era",
    ],
    "sarcasm_delayed": [
        "if only the scoreboard agreed", "until you check the scoreboard", "except the results",
        "for everyone except the team", "still somehow not performing",
    ],
    "sarcasm_comparisons": [
        "like a geological era", "like a meditation retreat", "like a rare art exhibit", "as optional as fielding",
    ],
    "sarcasm_praise": [
        "masterclass", "brilliant", "amazing", "fantastic", "legendary", "outstanding", "elite", "visionary", "genius",
    ],
    "sarcasm_mismatch": [
        "not performing", "ignored", "selection mistakes", "selection problems", "same mistake",
        "repeated confusion", "slow", "dropped",
    ],
    "sarcasm_grief": ["five stages of grief"],
    "quote_context": [
        "people say", "some say", "others think", "we cannot say", "it is wrong to say", "it is unfair to say",
        "calling him", "labeling him", "just because",
    ],
    "rejection": [
        "we cannot say", "cannot say", "it is wrong to say", "it is unfair to say", "wrong", "unfair", "incorrect",
        "not true", "not fair", "do not agree",
    ],
    "endorsement": [
        "and they are right", "and thats right", "they are right", "right to call", "correct to call",
    ],
    "fairness_defense": [
        "irrelevant to judge", "not fair to judge", "unfair to judge", "cannot judge based on",
        "should not judge based on", "different phase of career", "context was different", "role was different",
        "he has evolved", "player has improved", "progressing now", "recent improvement", "environment matters",
        "confidence matters", "team role matters", "still developing", "young player evolves",
        "needs right environment", "numbers do not tell the full story", "stats alone do not explain",
    ],
    "reputation_defense": [
        "torchbearer", "important player", "valuable player", "clear player mentally", "strong mindset",
        "talented player", "high potential", "future looks good", "has shown improvement", "still has ability",
        "quality player",
    ],
    "criticism_reference": [
        "people judge", "people still judge", "many judge", "many people judge", "some judge", "critics judge",
        "critics judge based on", "fans judge", "fans judge based on", "often judged", "judged based on earlier",
        "judged based on past", "judged based on previous performances", "focus on strike rate",
        "focus only on numbers", "based on earlier seasons", "based on past performances",
        "based only on statistics", "concerns from earlier phase", "based on earlier concerns",
        "based on earlier weaknesses", "previous strike rate", "earlier numbers", "old performances",
        "old numbers", "old numbers alone", "based on old numbers",
    ],
    "criticism_strong": [
        "people still judge", "many people judge", "fans judge based on", "critics judge based on",
        "judged based on earlier", "judged based on past", "judged based on previous performances",
        "concerns from earlier phase", "based on earlier concerns", "based on earlier weaknesses",
    ],
    "context_change": [
        "role changed", "confidence changed", "environment changed", "team role changed", "different situation",
        "different phase", "recent improvement", "recent performances suggest", "has improved", "has adapted",
        "still developing", "young player improves", "settled into role", "clearer environment",
        "role was different", "context was different", "has evolved",
    ],
    "evaluation_redirection": [
        "makes more sense to evaluate", "better to evaluate", "should evaluate based on", "judge based on current",
        "current progress matters", "recent progress matters", "not only based on earlier numbers",
        "instead of relying on earlier numbers", "rather than earlier numbers", "evaluate him differently now",
        "not fair to judge based on old numbers", "not fair to judge based on old numbers alone",
    ],
    "credibility_restoration": [
        "still a quality player", "still important player", "still valuable player", "has strong ability",
        "has improved recently", "has shown improvement", "future looks positive", "has potential",
        "clear player mentally", "talented player",
    ],
    "contrast_structure": [
        "but", "however", "instead", "rather", "although", "even though", "while others think", "some believe",
        "critics argue",
    ],
    "disagreement_context": [
        "people say", "some say", "others think", "many argue", "critics say", "critics argue",
        "while others think", "some believe", "judge", "judged",
    ],
    "mixed_intent": ["but", "still"],
    "tag_rhetorical": ["really?", "seriously?", "is this", "what exactly"],
    "tag_quoted": ["people say", "some say", "others believe", "analysts say"],
    "tag_reported": ["analysts", "reports", "people say", "some say", "others believe"],
    "tag_conversational": ["honestly", "really", "you know", "i think", "it feels"],
    # --- constructiveness and discourse -------------------------------------
    "reasoning": [
        "because", "since", "if", "then", "therefore", "which means", "this shows", "this suggests", "as a result",
        "so that", "due to", "instead of", "rather than", "compared to", "could improve", "should improve",
        "would help", "needs improvement", "can improve", "better strategy", "when that happens",
        "because of that", "which made it difficult", "which reduced", "which affected", "which created",
        "which limited", "as a result", "this meant that", "this caused", "this made",
    ],
    "constructive_suggestion": [
        "should", "could", "would", "needs to", "can improve", "must consider", "better if", "important to",
    ],
    "problem": ["problem", "issue", "struggle", "failed", "collapse", "mistake", "weak"],
    "implication": [
        "so", "therefore", "which means", "as a result", "then", "will", "which reduced", "which improved",
        "that allowed", "that created", "that prevented",
    ],
    "explanation_connectors": [
        "instead of", "rather than", "which reduced", "which improved", "that allowed", "that created",
        "that prevented",
    ],
    "strategic": [
        "selection decisions", "team balance", "role clarity", "match conditions", "bowling flexibility",
        "middle overs", "pitch conditions", "tactical role", "long-term structure", "combination decisions",
        "usage strategy", "team composition", "opposition strengths", "attack balance", "containment role",
    ],
    "simple_problem": [
        "difficult to perform", "difficult for them to perform", "selection becomes unclear",
        "planning becomes weak", "performance suffers", "learning does not happen", "learning did not happen",
    ],
    "simple_consequence": [
        "reduced confidence", "team loses benefit", "team loses the benefit", "results repeat", "results repeated",
        "which reduced", "which affected", "which created", "which limited", "this caused", "this made",
        "as a result",
    ],
    "respectful": ["respect", "fair", "appreciate", "support", "calm", "balanced"],
    "constructiveness_abuse": [
        "idiot", "moron", "stupid", "trash", "useless", "pathetic", "loser", "clown",
    ],
    "discourse_contrast": [
        "however", "but", "while", "although", "at the same time", "instead of", "rather than",
        "in those situations",
    ],
    "discourse_frames": [
        "what made this important", "what changed the situation", "what influenced the outcome",
        "what shaped the result",
    ],
    "discourse_events": ["when", "after", "before", "during", "in the final", "session", "over"],
    "discourse_interpretation": [
        "this showed", "this suggests", "this means", "the point is", "it revealed", "because of this",
        "in those situations", "going forward", "this meant that", "this caused", "this made",
    ],
    "discourse_impact": [
        "as a result", "therefore", "impact", "outcome", "so the team", "which led to", "which reduced",
        "which improved", "which created", "which allowed", "because of this", "going forward",
        "in those situations",
    ],
    # --- paragraph components -------------------------------------------------
    "abuse_words": [
        "idiot", "moron", "stupid", "trash", "garbage", "useless", "pathetic", "loser", "shut up", "disgusting",
        "hate you",
    ],
    "analytical_reasoning_terms": ["because", "therefore", "however", "so that", "if", "then", "reason", "impact"],
    "analytical_terms": ["strategy", "tactic", "pattern", "selection", "role", "balance", "conditions"],
    "analytical_phrases": ["because", "therefore", "as a result", "which means", "instead of", "rather than"],
    "civility_terms": ["respect", "fair", "appreciate", "credit", "please", "calm", "balanced"],
    "fan_terms": ["we", "our", "i", "us", "support", "fans", "team", "believe", "care"],
    "debate_terms": ["on the other hand", "although", "while", "whereas", "counter", "rebuttal", "yet"],
    # --- writing quality ------------------------------------------------------
    "position": [
        "i believe", "in my view", "this suggests", "the point is", "overall", "i think", "in conclusion",
    ],
    "counter_argument": [
        "however", "although", "on the other hand", "some argue", "but", "while others", "nevertheless", "yet",
    ],
    "argument_logic": [
        "because", "therefore", "since", "as a result", "which means", "thus", "hence", "consequently",
    ],
    "evidence": [
        "strike rate", "average", "economy", "runs", "wickets", "balls", "overs", "innings", "powerplay", "match",
        "series", "season",
    ],
    "clause_words": ["because", "however", "although", "while", "therefore"],
    "intro": ["first", "to begin", "in this", "consider", "regarding", "overall"],
    "argument": ["because", "this means", "which shows", "therefore", "as a result", "suggests"],
    "conclusion": ["in conclusion", "overall", "therefore", "this shows", "to sum up", "finally"],
    "stopwords": [
        "the", "a", "an", "and", "or", "but", "if", "then", "in", "on", "at", "to", "of", "for", "with", "as",
        "by", "is", "are", "was", "were", "be", "been", "being", "that", "this", "it", "he", "she", "they", "we",
        "you", "i",
    ],
    "content_suffixes": ["ing", "ed", "ly", "ive", "ous", "al", "tion", "ment", "ness"],
    # --- writer type ------------------------------------------------------------
    "writer:Passionate Fan": ["we", "our", "support", "believe", "proud", "heart", "fans", "care", "back"],
    "writer:Analyst": [
        "because", "therefore", "evidence", "data", "strategy", "tactic", "trend", "rate", "phase", "matchup",
        "sequence", "process", "problem", "approach", "structure", "discipline", "role",
    ],
    "writer:Storyteller": [
        "when", "then", "moment", "remember", "crowd", "scene", "suddenly", "after", "lights", "silence", "roar",
        "watched",
    ],
    "writer:Debater": [
        "however", "on the other hand", "although", "while", "but", "whereas", "counter", "both", "fair",
        "balanced", "argue", "argument", "viewpoint", "compare", "comparing",
    ],
    "writer:All-Rounder": ["overall", "balance", "mix", "both", "combined", "together"],
    # --- rescue, complaint and fusion text checks ---------------------------------
    "rescue_reasoning": [
        "because", "therefore", "however", "while", "although", "whereas", "if", "then", "shows", "suggests",
        "approach", "problem", "structure", "evidence", "argues", "argument", "compare", "comparing",
        "balanced view", "both sides", "middle ground", "on the other hand", "next steps", "resilience",
        "adjustment",
    ],
    "rescue_suggestion": [
        "should", "could", "need to", "needs to", "better approach", "adjust", "improve", "fix", "next steps",
    ],
    "rescue_complaint": [
        "same script", "nothing ever changes", "more of the same", "another frustrating", "every week",
        "recurring pattern", "tired of", "frustrating", "disappointed",
    ],
    "cap_complaint": [
        "same script", "nothing ever changes", "more of the same", "another frustrating", "every week",
        "supporters deserve stronger", "recurring pattern", "same mistake again", "nothing changes",
        "always happens", "management never learns", "waste of opportunity",
        "repeated failure without explanation",
    ],
    "cap_reasoning": [
        "because", "therefore", "however", "while", "although", "whereas", "if", "then", "evidence", "approach",
    ],
    "cap_suggestion": [
        "should", "could", "need to", "needs to", "improve", "fix", "adjust", "recommend",
    ],
    "insults": [
        "useless", "fraud", "idiot", "moron", "pathetic", "trash", "garbage", "disgrace", "clueless",
    ],
    "humiliation": ["disgrace to cricket", "embarrassment", "shameful", "humiliating", "joke"],
    "group_dismissal": ["anyone who supports", "people who support", "fans who support"],
    "dismissive": [
        "same script", "nothing changes", "management never learns", "frustrating", "poorly handled",
        "repeated mistakes", "no clear plan",
    ],
    "ceiling_suggestion": [
        "should", "could", "needs to", "need to", "improve", "reconsider", "adjust", "recommend", "better",
    ],
    # --- corpus labelling and filters -----------------------------------------------
    "label_supportive": [
        "unfair", "context matters", "judge based on", "earlier performances", "different phase",
        "recent improvement", "still a quality player", "makes more sense to evaluate",
    ],
    "label_constructive": ["should", "could", "needs to", "improve", "fix", "adjust", "recommend"],
    "label_complaint": [
        "again and again", "same confusion", "repeating mistakes", "frustrating to watch", "nothing changes",
    ],
    "label_attack": [
        "clearly not performing", "management ignoring problems", "useless", "trash", "not performing",
    ],
    "label_debate": ["some say", "others think", "on the other hand", "however", "while"],
    "topical": [
        "cricket", "ipl", "bcci", "icc", "odi", "t20", "test match", "world cup", "wicket", "bowler", "batter",
        "batsman", "batting", "bowling", "selection", "selectors", "team selection", "captain", "innings",
        "powerplay", "run chase", "over rate", "management", "coach", "rcb", "csk", "mi", "kkr", "rr", "srh",
        "dc", "pbks", "india", "pakistan", "australia", "england", "new zealand", "south africa", "jadeja",
        "kohli", "rohit", "rahul", "ashwin", "bumrah", "siraj", "gill", "jaiswal", "padikkal", "samson", "rinku",
        "iyer", "parag",
    ],
    "topical_player": [
        "kohli", "rohit", "rahul", "gill", "jaiswal", "iyer", "rinku", "samson", "padikkal", "parag", "jurel",
        "bumrah", "siraj", "hardik", "jadeja",
    ],
    "topical_selection": [
        "selection", "selected", "playing xi", "bench", "drop", "picked", "team", "captaincy", "management",
    ],
    "topical_criticism": [
        "not performing", "struggling", "failed", "poor", "bad", "again and again", "repeating mistakes",
    ],
    "topical_role": ["role", "position", "powerplay", "middle overs", "finisher", "anchor"],
    "topical_fairness": [
        "unfair", "context matters", "judge based on", "earlier performances", "different phase",
        "recent improvement", "still a quality player",
    ],
    "topical_debate": ["some say", "others think", "on the other hand", "however", "while"],
    "sports": [
        "cricket", "football", "basketball", "match", "team", "player", "selection", "captain", "bowling",
        "batting", "inning", "innings", "coach", "goal", "tournament", "league",
    ],
    "target_reasoning": ["because", "therefore", "so that", "as a result", "which means", "reason"],
    "target_suggestion": ["should", "could", "recommend", "suggest", "needs to", "would help", "better to"],
    "target_comparison": ["however", "while", "although", "on the other hand", "compared", "rather than"],
    "target_abuse": [
        "idiot", "moron", "stupid", "trash", "garbage", "pathetic", "loser", "useless", "hate you", "clown",
    ],
    # --- quick score ---------------------------------------------------------------
    "quick_positive": ["win", "won", "victory", "strong", "smart", "excellent", "dominant"],
    "quick_negative": ["loss", "lost", "poor", "bad", "weak", "mistake", "failure"],
    "quick_topic": ["strategy", "plan", "bowling", "batting", "finish", "cricket"],
    "quick_abuse": ["hate", "idiot", "stupid", "attack", "abuse"],
}

# Regular expressions (Java dialect; (?U) makes \b \s \w \d Unicode-aware, (?d) lets . match all but \n).
PATTERNS: dict[str, list[str]] = {
    "personal_attack": [r"(?U)\byou are\b", r"(?U)\bhe is\b", r"(?U)\bthey are\b", r"(?U)\bthat player is\b"],
    "target_attack": [r"(?U)\byou are\b|\bhe is\b|\bthey are\b"],
    "target_connector": [r"(?U)\bif\b|\bthen\b|\bso\b|\bthus\b"],
    "praise_mismatch": [
        r"(?d)(masterclass|brilliant|amazing|fantastic|legendary|outstanding|elite).{0,50}"
        r"(not performing|ignored|mistake|slow|dropped)"
    ],
    "praise_contradiction": [
        r"(?d)(visionary|brilliant|amazing|masterclass).{0,80}(but|until|except|while).{0,80}"
        r"(ignored|mistake|not performing|slow)"
    ],
    "mocking_tail": [r"(?d)(visionary|genius|masterclass).{0,30}really"],
    "contrast_rejection": [
        r"(?d)people say .+ but", r"(?d)some say .+ but", r"(?d)others think .+ but",
        r"(?d)many argue .+ however", r"(?d)critics say .+ but",
    ],
    "rejection_structure": [
        r"(?d)people say.*(but|however|instead|rather|actually).*(wrong|unfair|incorrect)"
    ],
    "endorsement_structure": [r"(?d)people say .* and (they are|that's) right"],
    "direct_verbs": [
        r"(?U)\b(is|are|has|have|keeps|clearly|should|must|handled|adapted|played|repeated|working)\b"
    ],
}
# substrings of which every match of the patterns holds one
NEEDED: dict[str, list[str]] = {
    "praise_mismatch": ["not performing", "ignored", "mistake", "slow", "dropped"],
    "praise_contradiction": ["not performing", "ignored", "mistake", "slow"],
    "mocking_tail": ["really"],
}

# Score anchors, bands and weights. Three band tables exist on purpose.
COMPONENT_MAX = {
    "constructiveness": 40.0, "respectfulness": 20.0, "analytical_tone": 15.0, "clarity": 10.0,
    "fan_sincerity": 15.0,
}
STANCE_ANCHORS = {
    "SUPPORTIVE_DEFENSE": 82.0, "CONSTRUCTIVE_CRITICISM": 78.0, "BALANCED_DEBATE": 76.0,
    "NEUTRAL_ANALYSIS": 64.0, "MIXED_STANCE": 55.0, "DISMISSIVE_COMPLAINT": 40.0, "DIRECT_ATTACK": 25.0,
}
FUSION_BANDS = {
    "DIRECT_ATTACK": (20.0, 45.0), "DISMISSIVE_COMPLAINT": (30.0, 55.0), "NEUTRAL_ANALYSIS": (40.0, 70.0),
    "BALANCED_DEBATE": (60.0, 80.0), "CONSTRUCTIVE_CRITICISM": (65.0, 85.0), "SUPPORTIVE_DEFENSE": (70.0, 95.0),
}
CALIBRATION_BANDS = {
    "SUPPORTIVE_DEFENSE": (70.0, 85.0), "CONSTRUCTIVE_CRITICISM": (62.0, 82.0), "NEUTRAL_ANALYSIS": (45.0, 65.0),
    "BALANCED_DEBATE": (55.0, 75.0), "DISMISSIVE_COMPLAINT": (25.0, 50.0), "DIRECT_ATTACK": (0.0, 25.0),
    "MIXED_STANCE": (35.0, 68.0),
}
# label -> (score band, toxicity band, supportive band)
LABEL_BANDS = {
    "SUPPORTIVE_DEFENSE": ((70.0, 85.0), (0.0, 0.12), (0.45, 1.0)),
    "CONSTRUCTIVE_CRITICISM": ((62.0, 82.0), (0.0, 0.18), (0.1, 0.5)),
    "NEUTRAL_ANALYSIS": ((45.0, 65.0), (0.0, 0.15), (0.0, 0.35)),
    "BALANCED_DEBATE": ((55.0, 75.0), (0.0, 0.22), (0.05, 0.45)),
    "DISMISSIVE_COMPLAINT": ((25.0, 50.0), (0.05, 0.35), (0.0, 0.2)),
    "DIRECT_ATTACK": ((0.0, 25.0), (0.2, 1.0), (0.0, 0.1)),
    "MIXED_STANCE": ((35.0, 68.0), (0.0, 0.35), (0.05, 0.4)),
}
# writer type -> multiplier of each component, then toxicity strength
WRITER_PROFILES = {
    "Passionate Fan": {"respectfulness": 1.1, "analytical_tone": 0.9, "clarity": 1.0, "fan_sincerity": 1.22,
                       "toxicity_strength": 1.2},
    "Analyst": {"respectfulness": 1.02, "analytical_tone": 1.24, "clarity": 1.12, "fan_sincerity": 0.85,
                "toxicity_strength": 1.2},
    "Storyteller": {"respectfulness": 1.08, "analytical_tone": 0.92, "clarity": 1.2, "fan_sincerity": 1.15,
                    "toxicity_strength": 1.2},
    "Debater": {"respectfulness": 1.12, "analytical_tone": 1.04, "clarity": 1.06, "fan_sincerity": 0.95,
                "toxicity_strength": 1.2},
    "All-Rounder": {"respectfulness": 1.0, "analytical_tone": 1.0, "clarity": 1.0, "fan_sincerity": 1.0,
                    "toxicity_strength": 1.15},
}
WRITER_FLOORS = {
    "Passionate Fan": 75.0, "Storyteller": 75.0, "Analyst": 80.0, "Debater": 80.0, "All-Rounder": 60.0,
}
UPLIFT_WEIGHTS = {
    "Passionate Fan": {"constructiveness": 0.52, "fan_sincerity": 0.33, "clarity": 0.15},
    "Storyteller": {"clarity": 0.45, "fan_sincerity": 0.35, "constructiveness": 0.2},
    "Analyst": {"analytical_tone": 0.42, "constructiveness": 0.33, "clarity": 0.25},
    "Debater": {"analytical_tone": 0.35, "constructiveness": 0.35, "respectfulness": 0.2, "clarity": 0.1},
    "All-Rounder": {"constructiveness": 0.3, "respectfulness": 0.2, "analytical_tone": 0.2, "clarity": 0.15,
                    "fan_sincerity": 0.15},
}
FLOOR_QUALITY_WEIGHTS = {
    "Analyst": {"constructiveness": 0.35, "respectfulness": 0.15, "analytical_tone": 0.35, "clarity": 0.15},
    "Storyteller": {"constructiveness": 0.28, "respectfulness": 0.22, "clarity": 0.2, "fan_sincerity": 0.3},
    "Debater": {"constructiveness": 0.34, "respectfulness": 0.28, "analytical_tone": 0.26, "clarity": 0.12},
    "other": {"constructiveness": 0.32, "respectfulness": 0.22, "clarity": 0.18, "fan_sincerity": 0.18,
              "analytical_tone": 0.1},
}
# archetype key -> (writer type, component weights of the fusion)
ARCHETYPES = {
    "analyst_score": ("Analyst", {
        "stat_accuracy": 0.30, "stance": 0.25, "writing_quality": 0.20, "argument_logic": 0.15,
        "information_density": 0.10}),
    "fan_score": ("Passionate Fan", {
        "stance": 0.40, "writing_quality": 0.25, "toxicity": 0.15, "engagement_style": 0.10, "structure": 0.10}),
    "storyteller_score": ("Storyteller", {
        "writing_quality": 0.35, "coherence": 0.20, "stance": 0.20, "information_density": 0.15,
        "structure": 0.10}),
    "debater_score": ("Debater", {
        "argument_logic": 0.30, "counter_argument": 0.20, "stance": 0.20, "writing_quality": 0.15,
        "stat_accuracy": 0.15}),
}
STANCE_STRENGTH_BASE = {
    "SUPPORTIVE_DEFENSE": 0.84, "CONSTRUCTIVE_CRITICISM": 0.76, "BALANCED_DEBATE": 0.70,
    "NEUTRAL_ANALYSIS": 0.58, "MIXED_STANCE": 0.52, "DISMISSIVE_COMPLAINT": 0.40, "DIRECT_ATTACK": 0.20,
    "SARCASTIC_CRITICISM": 0.32,
}
SENTIMENT_ANCHORS = {"positive": 78.0, "neutral": 62.0, "negative": 40.0}
TARGET_SENTIMENT_BASE = {"positive": 78.0, "neutral": 66.0, "negative": 58.0}
REBALANCE_VARIANTS = [
    ("", ""),
    ("", " This should be judged with role context."),
    ("", " Selection context matters for interpretation."),
    ("In this match context, ", ""),
]
TEXT_COLUMNS = ["text", "full_text", "tweet", "content"]
TEXT_COLUMNS_WIDE = ["text", "tweet", "content", "body", "full_text", "message"]
SPLIT_COLUMNS = [
    "text", "stance_label", "confidence", "expected_score_band", "expected_toxicity_band",
    "expected_supportive_strength_band",
]
DIAGNOSTIC_COLUMNS = [
    "sample_id", "text", "expected_writer_type", "predicted_writer_type", "expected_constructive",
    "expected_toxic", "expected_score_range", "predicted_final_score", "constructiveness_signal",
    "reasoning_marker_score", "suggestion_score", "explanation_depth_score", "toxicity_score",
    "toxicity_penalty", "writer_confidence", "paragraph_count", "word_count", "deviation_from_expected_midpoint",
]
