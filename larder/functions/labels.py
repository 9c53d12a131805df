"""Labels, texts and constants that have to come out exactly as users of these reports know them."""

# ---- fixed values: menu matrix ------------------------------------------------------------------------------
STAR = "⭐ Star"
PLOWHORSE = "🐴 Plowhorse"
PUZZLE = "❓ Puzzle"
DOG = "🐕 Dog"
MENU_CATEGORIES = [STAR, PLOWHORSE, PUZZLE, DOG]
CATEGORY_BY_NAME = {"star": STAR, "plowhorse": PLOWHORSE, "puzzle": PUZZLE, "dog": DOG}

CATEGORY_ACTION = {
    STAR: "Promote heavily, protect margins, feature prominently",
    PLOWHORSE: "Consider 10-15% price increase, bundle with lower-margin items",
    PUZZLE: "Increase visibility, improve descriptions, run promotions",
    DOG: "Re-engineer, bundle with stars, or remove from menu",
}
CATEGORY_PRIORITY = {STAR: 1, PLOWHORSE: 2, PUZZLE: 3, DOG: 4}
CATEGORY_IMPACT = {STAR: "+15% visibility", PLOWHORSE: "+10% margin", PUZZLE: "+20% orders", DOG: "-25% waste"}
PRICING_RATIONALE = "Based on performance analysis"

# ---- fixed values: price bands, right-closed ----------------------------------------------------------------
PRICE_BAND_EDGES = [0, 25, 50, 75, 100, 150, 200]
PRICE_BAND_NAMES = ["0-25", "26-50", "51-75", "76-100", "101-150", "151-200", "200+"]

# ---- fixed values: cluster profiles -------------------------------------------------------------------------
PROFILE_STARS = "High Volume, Premium Price (Stars)"
PROFILE_VOLUME = "High Volume, Value Price (Volume Drivers)"
PROFILE_NICHE = "Low Volume, Premium Price (Niche Items)"
PROFILE_UNDER = "Low Volume, Low Price (Underperformers)"

# ---- fixed values: stock status -----------------------------------------------------------------------------
CRITICAL = "🔴 Critical - Stockout Risk"
LOW = "🟠 Low - Reorder Soon"
OPTIMAL = "🟢 Optimal"
HIGH = "🟡 High - Monitor"
EXCESS = "🔵 Excess - Overstock Risk"
UPLOAD_OK = "✅ OK"
STATUS_RANK = {CRITICAL: 0, LOW: 1, EXCESS: 2, HIGH: 3, OPTIMAL: 4}
ALERT_STATUSES = [CRITICAL, LOW, EXCESS]

# ---- fixed values: weekly actions ---------------------------------------------------------------------------
PRIORITY_RANK = {"High": 0, "Medium": 1, "Low": 2}
KIND_DEMAND = "📉 High Demand Alert (ML)"
KIND_RESTOCK = "🔴 Restock Alert"
KIND_EXCESS_SLOW = "📦 Excess Stock (Slow Moving)"
KIND_EXCESS = "📦 Excess Stock"
KIND_INVENTORY = "⚠️ Inventory Alert"
KIND_OVERVIEW = "⚠️ Inventory Overview"
KIND_CRITICAL_ML = "🔴 Critical Stock (ML Analysis)"
KIND_LOW_ML = "🟠 Low Stock (ML Analysis)"
KIND_EXCESS_ML = "📦 Excess Stock (ML Analysis)"
KIND_STARS = "⭐ Star Performers (ML)"
KIND_DOGS = "🐕 Menu Optimization (ML)"
KIND_PUZZLES = "💡 Growth Opportunity (ML)"
KIND_PLOWHORSES = "💰 Cost Optimization (ML)"
KIND_WEEKEND = "📅 Weekend Prep"

MSG_DEMAND = "Predicted to run out in %d days based on demand trends. Order %d units soon."
MSG_RESTOCK = "Stock critically low (%d). Below reorder point (%d)."
MSG_EXCESS_SLOW = "High inventory (%d) with low predicted demand. >60 days supply. Run a promotion."
MSG_EXCESS = "Overstocked (%d units). Consider running a promotion."
MSG_INVENTORY = "%d items are below reorder point. Review inventory dashboard for full list."
MSG_CRITICAL_ML = "Only %d units left (~%d days of stock). Reorder immediately."
MSG_LOW_ML = "Stock at %d units, approaching reorder point (%d). Plan reorder soon."
MSG_EXCESS_ML = "Overstocked with %d units (~%d days supply). Consider a promotion."
MSG_OVERVIEW = (
    "%d critical, %d low stock, %d excess items detected from ML demand analysis. "
    "Upload your CSV for live tracking."
)
MSG_STARS_NAMED = "Top performers identified in your inventory: %s. Promote them!"
MSG_DOGS_NAMED = "Underperforming items identified: %s. Consider removing or Bundle deals."
MSG_PUZZLES_NAMED = "Profitable but low volume items found. Increase visibility to boost sales."
MSG_PLOWHORSES_NAMED = "High volume but low margin items found. Consider small price increase."
MSG_STARS = "High-profit, high-popularity items identified. Promote these on your menu to maximize revenue."
MSG_DOGS = "Low-profit, low-popularity items found. Consider removing or bundling with star items."
MSG_PUZZLES = "Profitable but underordered items. Increase visibility with featured placement or deals."
MSG_PLOWHORSES = "Popular but low-margin items. A small price increase could significantly boost profit."
MSG_WEEKEND = (
    "Weekend peak expected. Ensure adequate staffing and stock levels for high-demand items."
)

# ---- fixed values: question rules, tried in this order -------------------------------------------------------
QUESTION_RULES = [
    ("best_items", ["best", "top", "performing", "star"], 0.85),
    ("items_to_remove", ["remove", "drop", "eliminate", "dog"], 0.82),
    ("grow_revenue", ["revenue", "increase", "grow", "profit"], 0.78),
]
QUESTION_DEFAULT = ("general", 0.65)

# ---- fixed values: calendar ---------------------------------------------------------------------------------
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
