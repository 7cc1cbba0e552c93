"""What prompts say. Braces mark what a plan puts in."""

from __future__ import annotations

# Names of the tones, in menu order.
TONES = ("Friendly", "Professional", "Empathetic", "Enthusiastic", "Confident", "Conversational")
# End of fixed values.

#: How each tone introduces itself in variant prompts.
PERSONAS = {
    "Friendly": "Write as a host at {business_name} who is glad to hear from guests: kind words, short sentences, nothing stiff.",
    "Professional": "Write as the person at {business_name} who answers public feedback: courteous, exact and calm.",
    "Empathetic": "Write as the listener at {business_name}: name how the visit must have felt first, then turn to what was said.",
    "Enthusiastic": "Write as the biggest supporter of {business_name}: bright, lively and thankful, without shouting.",
    "Confident": "Write as the owner of the word at {business_name}: plain, sure of the facts and ready to act.",
    "Conversational": "Write as a neighbour who works at {business_name}: easy, everyday language, as if across a counter.",
}

#: One line on each tone for prompts that let the model choose.
TONE_LINES = {
    "Friendly": "kind and close, as a regular would be greeted",
    "Professional": "courteous and exact, without stiffness",
    "Empathetic": "feelings first, facts second",
    "Enthusiastic": "bright and thankful, with energy to spare",
    "Confident": "plain and sure, no hedging",
    "Conversational": "everyday language, as between neighbours",
}

VOICE = "The reply speaks for {business_name} as a whole.\nSay we, us and our throughout; no sentence may say I, me or my."

GUARDRAILS = (
    "Limits that always hold:\n"
    "- Show that the feedback was heard, and leave its complaint details unspoken.\n"
    "- Keep the reviewer's wording out of the reply, apart from approved keywords listed in this request.\n"
    "- Leave out the names of people who work here.\n"
    "- Promise nothing beyond this one visit."
)

BRAND = "Sound like this business on a good day, and skip phrases that any company could have sent."

TONE_MENU = "Pick one tone for the reply; what the review says outweighs its stars.\n" + "\n".join(f"- {name}: {TONE_LINES[name]}" for name in TONES) + "\nDo not say which tone was picked."

NEGATIVE = "One or two stars: begin with the disappointment, stay measured, and offer to go on in private. Approved keywords stay unused here."
NEUTRAL = "Three stars: give equal room to what went well and what did not, in general terms."
NEUTRAL_KEYWORDS = "Three stars: give equal room to what went well and what did not, in general terms.\nThis approved keyword occurs in the review and may be used: {keywords}."
POSITIVE = "Four or five stars: thank the reviewer with as much warmth as the tone allows, and stop once it is said."
POSITIVE_KEYWORDS = "Four or five stars: thank the reviewer with as much warmth as the tone allows, and stop once it is said.\nThese approved keywords occur in the review and may be used: {keywords}."

#: Length instructions: with review text, and without.
LENGTH_WITH_TEXT = "Answer the review and its rating in at most {word_limit} words."
LENGTH_WITHOUT_TEXT = "Answer the rating alone in at most {word_limit} words."
FORMATTING = "The body of the reply holds no e-mail address, no hashtag and no @mention."
TOKENS = "Work these details in: {tokens}."
SIGNATURE = "Close with: {signature}."

CONTACT_EARLY = "Point to the contact details within the first two sentences, so that the talk can go on in private."
CONTACT_OFFER = "Mention the contact details if the reviewer may want more help."
CONTACT_OPTIONAL = "Use the contact details only where they come up by themselves."

MENU_HEAD = "Pick one tone for the reply; what the review says outweighs its stars.\n\nTones to pick from:"
MENU_TAIL = "Keep to the tone that fits best, and do not name it."
CLIENT = "Client Instructions:\n{client_instructions}"
CUSTOMER = "Customer Information:\nReview Text: {review_text}\nRating: {rating}\nReviewer Name: {reviewer_name}"
GROUNDING = "Grounding Instruction:\nBegin with one concrete thing that the review mentions. With no review text, answer the rating and make nothing up."
EXTRACTION = "First look for the most concrete word or moment in the review text; the opening sentence has to be about it, and not about thanks."
GUIDE_LOW = "- 1-2 stars: brief understanding, then the way to support."
GUIDE_MIDDLE = "- 3 stars: even-handed and practical."
GUIDE_HIGH = "- 4-5 stars: thanks that name something particular."
GUIDE_HIGH_EXTRACTED = "- 4-5 stars: thanks that rest on the detail found above."
GUIDE = "Rating Interpretation:\n" + GUIDE_LOW + "\n" + GUIDE_MIDDLE + "\n{high}\n\nIf words and stars disagree, answer the words and do not point it out."
RULES_HEAD = "Response Requirements:\n- At most {response_length} words."
RULES_TONE = "- One tone from start to end.\n- No stock phrases of companies."
RULES_TAIL = "- No hashtags and no @mentions.\n- No retelling of the complaint.\n- Amends concern this visit alone.\n- No names of staff.\n- No paraphrase of the review.\n- No invented facts, no promises that can't be kept."
KEYWORDS = "Keyword Instructions:\n\nKeyword List:\n{keywords}\n\nOf these, use at most 2 that belong to what the review is about, within ordinary sentences; add none and force none."
VARIANT_TOKENS = "Details that may be worked in:\n{tokens}"
VARIANT_SIGNATURE = "Close with this signature:\n{signature}"
