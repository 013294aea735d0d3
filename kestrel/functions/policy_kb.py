"""The knowledge base of an invented marketplace for household machines and daily goods, and its retrieval answer key.

The base is part of the product, like the rule tables: fixed, short and the same at every data size, so it may be
broadcast.  The answer key names, for each query, every document that helps to answer it.
"""
from __future__ import annotations

import re

# ---------------------------------------------------------------------------------------
# FIXED VALUES: (document, title, text) and (query, relevant documents).
DOCUMENTS = [
    ("warranty", "Warranty of machines", "Every machine has a warranty of twenty-four months that starts on the date of its invoice. Lamps, filters and glass are wear parts and have no warranty. "
     "Opening the housing yourself ends the warranty."),
    ("repair", "Repair at home", "A technician comes to your home to repair a machine that is under warranty, and the visit costs nothing. Outside the warranty the visit has a flat fee of 350. "
     "You choose the morning or the afternoon when you book it."),
    ("parts", "Spare parts", "Spare parts stay available for seven years after a model is no longer made. Find the number of a part on the sticker inside the door."),
    ("invoice", "Invoices", "The invoice is a file in your account as soon as the order is packed. A company adds its tax number before it pays, since a finished invoice is never changed."),
    ("instalments", "Paying by instalments", "Orders above 5,000 can be paid by instalments over three, six or nine months. The first instalment is due when the order is packed. "
     "A missed instalment closes this way of paying for a year."),
    ("declined", "Declined cards", "A declined card keeps the order on hold until midnight. Pay with another card or by bank transfer before then, or the order lapses."),
    ("address", "Changing the address", "The address of an order can be changed in the account while its status says received. Later only the carrier can change the address, and only within the same town."),
    ("lockers", "Parcel lockers", "Parcels up to 15 kilograms may go to a parcel locker. The code for the locker comes by message and works for four days. Parcels that nobody fetches travel back to the warehouse."),
    ("missed", "Missed carriers", "When nobody opens the door the carrier tries twice more on the following days. After the third try the parcel waits at the depot for a week."),
    ("heavy", "Heavy goods", "Two people carry washing machines, ovens and fridges up to any floor. Tell us about narrow stairs, as a crane has to be ordered beforehand. The old machine is taken along if it is unplugged and empty."),
    ("points", "Points", "Each full 100 that you spend earns two points, and points lapse after eighteen months without an order. Points pay for goods, never for carriage or fees."),
    ("vouchers", "Vouchers", "A voucher is valid for five years and may be used in several orders. What is left on a voucher cannot be turned into cash. A lost voucher is blocked and issued anew if you know its number."),
    ("prices", "Falling prices", "If a price falls during the six days after you ordered, ask for the difference as points. Auctions and clearance shelves are left out."),
    ("signin", "Signing in", "Five wrong passwords lock the account for half an hour. A new password is set through the link that we mail, which works once. We never ask for a password on the phone."),
    ("closing", "Closing an account", "An account is closed on request once no order is open. Invoices are kept for ten years by law, everything else is erased within a month."),
    ("reviews", "Reviews", "Only buyers of a product can review it, and each buyer once. A review that names a person or another shop is taken down."),
    ("subscriptions", "Subscriptions", "Coffee, detergent and pet food come as a subscription every two, four or eight weeks. Skip a subscription any time until two days before it is packed. "
     "A subscription is 7 percent cheaper than single orders."),
    ("batteries", "Batteries and liquids", "Batteries and sprays never travel by air, so islands wait up to three weeks for them. Swollen batteries go to a recycling yard and must not be mailed to us."),
    ("unwanted", "Goods you do not want", "Unused goods can go back within thirty days, in any box, with the slip from your account. The refund is paid the way you paid, on the day the warehouse scans the box. "
     "Food, opened filters and engraved goods are excluded."),
]
ANSWER_KEY = [
    ("How long is the warranty of a machine and when does it start?", ("warranty",)),
    ("What does a technician visit cost to repair my machine?", ("repair",)),
    ("Can I pay an order by instalments over six months?", ("instalments",)),
    ("My card was declined, how do I keep the order?", ("declined",)),
    ("Can the address of my order still be changed?", ("address",)),
    ("Nobody was home, where does my parcel wait?", ("missed", "lockers")),
    ("Will they take the old washing machine along?", ("heavy",)),
    ("Do points or a voucher pay for carriage?", ("points", "vouchers")),
    ("The price fell after I ordered, do I get the difference?", ("prices",)),
    ("How do I skip a subscription of coffee?", ("subscriptions",)),
    ("When is the refund paid for unused goods that go back?", ("unwanted",)),
    ("Where do old batteries and opened filters go?", ("batteries", "unwanted")),
]
# ---------------------------------------------------------------------------------------


def chunks() -> list[tuple[str, str, str, str]]:
    """(chunk id, document, title, sentence) of the base, by the sentence rule of ``retrieval.sentence_chunks``."""
    out = []
    for doc, title, text in DOCUMENTS:
        for i, sentence in enumerate(s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text.strip())):
            out.append((f"{doc}-{i:02d}", doc, title, sentence))
    return out
