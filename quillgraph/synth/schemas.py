"""Graph schemas of ten domains, three each, written in a small notation.

A node is ``Name: property, property``; a property is ``name [type] [low..high | a|b|c]``,
with ``!`` after the name for a unique one and string as the default type. What depends on
earlier properties says so: ``name type = formula``, ``name type after other`` (a date that
does not lie before another), ``name type if predicate`` (null elsewhere). An edge is
``Name TYPE Name cardinality [source cap / target cap]``. A rule is ``rule [kind] name Where:
predicate``, where Where is a node or a relationship type, whose predicates are over
source.x and target.x; of kind reference it is ``ends``, ``source`` or ``target``. Without a
kind a rule is business logic. A cycle is a path that ends where it began.
"""

from __future__ import annotations

from quillgraph.catalog import BusinessConstraint, CyclePattern, GraphSchema, NodeType, Property, RelationshipType

SOURCES = {
    "banking": """
        Customer: customer_id!, name, age int 18..80, segment retail|private|business, since date
        Account: account_id!, kind checking|savings, balance float 0..100000, opened date, active boolean
        Branch: branch_id!, city, founded int 1850..2020
        Customer HOLDS Account 1:N 4/1
        Account SWEEPS_TO Account N:M
        Account HELD_AT Branch N:1 1/
        rule adult Customer: age >= 18
        rule solvent Account: balance >= 0
        rule reference housed HELD_AT: ends
        cycle Account SWEEPS_TO Account SWEEPS_TO Account""",
    "lending": """
        Borrower: borrower_id!, name, income float 12000..200000, score int 300..850
        Loan: loan_id!, principal float 500..90000, rate float 0.01..0.2, interest float = round(principal * rate; 2), state open|repaid|lost, granted date, closed date if state <> 'open'
        Officer: officer_id!, name, desk int 1..40
        Borrower TAKES_OUT Loan 1:N 6/1
        Officer APPROVES Loan 1:N /1
        Borrower VOUCHES_FOR Borrower N:M
        rule numeric interest_adds_up Loan: abs(interest - principal * rate) < 0.01
        rule state open_loans_have_no_end Loan: state <> 'open' OR closed IS NULL
        rule scored Borrower: score BETWEEN 300 AND 850
        cycle Borrower VOUCHES_FOR Borrower VOUCHES_FOR Borrower VOUCHES_FOR Borrower""",
    "insurance": """
        Holder: holder_id!, name, born date
        Policy: policy_id!, kind car|house|life, premium float 50..4000, starts date, ends date after starts
        Claim: claim_id!, amount float 10..50000, filed date, settled date after filed
        Holder INSURED_BY Policy 1:N 5/1
        Claim AGAINST Policy N:1 1/
        Claim FOLLOWS_UP Claim N:M
        rule temporal policy_runs Policy: ends >= starts
        rule temporal claim_settles Claim: settled >= filed
        rule reference claimed AGAINST: source
        cycle Claim FOLLOWS_UP Claim FOLLOWS_UP Claim""",
    "retail": """
        Shopper: shopper_id!, name, tier bronze|silver|gold
        Product: product_id!, title, price float 1..900, stock int 0..500
        Basket: basket_id!, created datetime, state open|paid|sent
        Shopper FILLS Basket 1:N 20/1
        Basket HOLDS Product N:M
        Product GOES_WITH Product N:M
        rule priced Product: price > 0
        cycle Product GOES_WITH Product GOES_WITH Product""",
    "wholesale": """
        Vendor: vendor_id!, name, city
        Pallet: pallet_id!, boxes int 1..60, weight float 0.5..20, load float = round(boxes * weight; 2)
        Shop: shop_id!, name, area float 40..3000
        Vendor PACKS Pallet 1:N /1
        Pallet SENT_TO Shop N:1 1/
        Shop LENDS_TO Shop N:M
        rule numeric load_adds_up Pallet: abs(load - boxes * weight) < 0.01
        rule reference sent SENT_TO: ends
        cycle Shop LENDS_TO Shop LENDS_TO Shop LENDS_TO Shop""",
    "auction": """
        Seller: seller_id!, name, since date
        Lot: lot_id!, title, floor float 1..500, opens datetime, closes datetime after opens
        Bidder: bidder_id!, name, limit_ float 10..9000
        Seller OFFERS Lot 1:N /1
        Bidder BIDS_ON Lot N:M
        Bidder OUTBIDS Bidder N:M
        rule temporal lot_closes Lot: closes >= opens
        rule floor_is_positive Lot: floor > 0
        cycle Bidder OUTBIDS Bidder OUTBIDS Bidder""",
    "health": """
        Patient: patient_id!, name, born date, blood A|B|AB|O
        Doctor: doctor_id!, name, field heart|bones|skin|eyes, years int 0..45
        Visit: visit_id!, at datetime, cost float 20..900
        Patient MAKES Visit 1:N /1
        Doctor RECEIVES Visit 1:N /1
        Doctor REFERS_TO Doctor N:M
        rule paid Visit: cost >= 0
        cycle Doctor REFERS_TO Doctor REFERS_TO Doctor REFERS_TO Doctor""",
    "pharmacy": """
        Drug: drug_id!, title, dose float 0.1..900, form pill|drops|cream
        Recipe: recipe_id!, written date, filled date after written, repeats int 0..5
        Chemist: chemist_id!, name, town
        Recipe NAMES_DRUG Drug N:M 4/
        Chemist FILLS_RECIPE Recipe 1:N /1
        Drug INTERACTS_WITH Drug N:M
        rule temporal filled_later Recipe: filled >= written
        rule few_repeats Recipe: repeats <= 5
        cycle Drug INTERACTS_WITH Drug INTERACTS_WITH Drug""",
    "laboratory": """
        Sample: sample_id!, taken datetime, state waiting|running|done, result float 0..100 if state = 'done'
        Device: device_id!, model, slots int 1..96
        Analyst: analyst_id!, name, grade int 1..9
        Sample RUN_ON Device N:1 1/
        Analyst HANDLES Sample 1:N /1
        Device FEEDS_INTO Device N:M
        rule state results_come_last Sample: state = 'done' OR result IS NULL
        rule reference run RUN_ON: source
        cycle Device FEEDS_INTO Device FEEDS_INTO Device""",
    "education": """
        Student: student_id!, name, year int 1..6
        Course: course_id!, title, credits int 1..12
        Teacher: teacher_id!, name, room int 100..399
        Student TAKES Course N:M 8/
        Teacher GIVES Course 1:N 4/1
        Course NEEDS Course N:M
        rule credited Course: credits BETWEEN 1 AND 12""",
    "library": """
        Reader: reader_id!, name, joined date, left_on date after joined
        Book: book_id!, title, pages int 20..1500, printed int 1800..2024
        Shelf: shelf_id!, hall, width float 0.5..4
        Reader BORROWS Book N:M 7/
        Book STANDS_ON Shelf N:1 1/
        Book CITES Book N:M
        rule temporal leaves_later Reader: left_on >= joined
        rule reference shelved STANDS_ON: source
        cycle Book CITES Book CITES Book""",
    "research": """
        Author: author_id!, name, papers int 0..400
        Paper: paper_id!, title, pages int 2..60, cited int 0..9000, per_page float = round(cited / pages; 3)
        Grant: grant_id!, sum float 1000..900000, starts date, ends date after starts
        Author WROTE Paper N:M
        Grant PAID_FOR Paper 1:N /2
        Paper BUILDS_ON Paper N:M
        rule numeric cited_a_page Paper: abs(per_page - cited / pages) < 0.001
        rule temporal grant_runs Grant: ends >= starts
        cycle Paper BUILDS_ON Paper BUILDS_ON Paper BUILDS_ON Paper""",
    "travel": """
        Airport: airport_id!, city, runways int 1..6
        Flight: flight_id!, leaves datetime, minutes int 30..900, seats int 20..400
        Traveller: traveller_id!, name, miles int 0..90000
        Flight FROM_AIRPORT Airport N:1 1/
        Flight TO_AIRPORT Airport N:1 1/
        Traveller BOARDS Flight N:M
        rule long_enough Flight: minutes >= 30""",
    "hotels": """
        House: house_id!, city, stars int 1..5
        Room: room_id!, beds int 1..6, price float 30..900, per_bed float = round(price / beds; 2)
        Guest: guest_id!, name, arrives date, leaves date after arrives
        House HAS_ROOM Room 1:N /1
        Guest SLEEPS_IN Room N:1 1/
        Guest TRAVELS_WITH Guest N:M
        rule temporal leaves_later Guest: leaves >= arrives
        rule numeric price_a_bed Room: abs(per_bed - price / beds) < 0.01
        cycle Guest TRAVELS_WITH Guest TRAVELS_WITH Guest""",
    "railway": """
        Station: station_id!, town, platforms int 1..24
        Train: train_id!, leaves datetime, arrives datetime after leaves, cars int 1..16
        Ticket: ticket_id!, price float 1..400, class first|second, used boolean
        Train STOPS_AT Station N:M
        Ticket VALID_ON Train N:1 1/
        Station TRACK_TO Station N:M
        rule temporal arrives_later Train: arrives >= leaves
        rule reference valid VALID_ON: source
        cycle Station TRACK_TO Station TRACK_TO Station TRACK_TO Station""",
    "social": """
        Person: person_id!, name, age int 13..90, joined date
        Post: post_id!, body, likes int 0..9000, at datetime
        Group: group_id!, title, open boolean
        Person WRITES Post 1:N /1
        Person FOLLOWS Person N:M
        Person MEMBER_OF Group N:M
        rule teen Person: age >= 13
        cycle Person FOLLOWS Person FOLLOWS Person""",
    "messaging": """
        User: user_id!, name, seen datetime
        Channel: channel_id!, topic, private boolean
        Message: message_id!, body, sent datetime, state sent|read|deleted, read_at datetime if state = 'read'
        User POSTS Message 1:N /1
        Message IN_CHANNEL Channel N:1 1/
        Message REPLIES_TO Message N:M
        rule state unread_has_no_time Message: state = 'read' OR read_at IS NULL
        rule reference placed IN_CHANNEL: source
        cycle Message REPLIES_TO Message REPLIES_TO Message""",
    "gaming": """
        Player: player_id!, name, level int 1..99
        Match: match_id!, mode duel|team|open, starts datetime, ends datetime after starts
        Item: item_id!, title, power int 1..500, price float = power * 1.5
        Player PLAYS Match N:M
        Player CARRIES_ITEM Item N:M 12/
        Player BEATS Player N:M
        rule temporal match_ends Match: ends >= starts
        rule numeric price_of_power Item: price = power * 1.5
        cycle Player BEATS Player BEATS Player BEATS Player""",
    "logistics": """
        Depot: depot_id!, city, area float 100..20000
        Truck: truck_id!, plate, load float 1..40
        Parcel: parcel_id!, weight float 0.1..60, state waiting|moving|done
        Truck BASED_AT Depot N:1 1/
        Truck CARRIES Parcel 1:N /1
        Depot ROAD_TO Depot N:M
        rule light Parcel: weight <= 60
        cycle Depot ROAD_TO Depot ROAD_TO Depot ROAD_TO Depot""",
    "shipping": """
        Harbour: harbour_id!, land, depth float 3..30
        Vessel: vessel_id!, flag, built int 1970..2024, crew int 4..60
        Container: container_id!, tare float 2..5, cargo float 0..28, gross float = round(tare + cargo; 3)
        Vessel CALLS_AT Harbour N:M
        Container STOWED_ON Vessel N:1 1/
        Harbour ROUTE_TO Harbour N:M
        rule numeric gross_adds_up Container: abs(gross - tare - cargo) < 0.001
        rule reference stowed STOWED_ON: ends
        cycle Harbour ROUTE_TO Harbour ROUTE_TO Harbour""",
    "postal": """
        Office: office_id!, town, opened date
        Letter: letter_id!, grams int 5..2000, posted date, delivered date after posted
        Carrier: carrier_id!, name, rounds int 1..9
        Letter POSTED_AT Office N:1 1/
        Carrier DELIVERS Letter 1:N /1
        Office FORWARDS_TO Office N:M
        rule temporal delivered_later Letter: delivered >= posted
        rule temporal office_is_open POSTED_AT: source.posted >= target.opened
        cycle Office FORWARDS_TO Office FORWARDS_TO Office""",
    "software": """
        Developer: developer_id!, name, commits int 0..20000
        Project: project_id!, title, language python|scala|rust, stars int 0..90000
        Ticket: ticket_id!, title, open boolean, filed date
        Developer MAINTAINS Project N:M 6/
        Ticket ABOUT Project N:1 1/
        Project IMPORTS Project N:M
        rule counted Project: stars >= 0
        cycle Project IMPORTS Project IMPORTS Project""",
    "cloud": """
        Host: host_id!, zone, cores int 2..128, memory int 4..1024
        Service: service_id!, title, replicas int 1..50, state up|down|drained, down_since datetime if state = 'down'
        Alarm: alarm_id!, level int 1..5, raised datetime, cleared datetime after raised
        Service RUNS_ON Host N:M
        Alarm RAISED_BY Service N:1 1/
        Service CALLS Service N:M
        rule state only_down_has_a_time Service: state = 'down' OR down_since IS NULL
        rule temporal cleared_later Alarm: cleared >= raised
        cycle Service CALLS Service CALLS Service CALLS Service""",
    "releases": """
        Build: build_id!, started datetime, finished datetime after started, passed boolean
        Release: release_id!, title, tagged date, retired date after tagged
        Tester: tester_id!, name, found int 0..900
        Build MAKES_RELEASE Release N:1 1/
        Tester SIGNS_OFF Release N:M
        Release REPLACES Release N:M
        rule temporal build_ends Build: finished >= started
        rule reference made MAKES_RELEASE: source
        cycle Release REPLACES Release REPLACES Release""",
    "energy": """
        Plant: plant_id!, name, kind wind|solar|water|gas, output float 1..2000
        Grid: grid_id!, region, load float 10..9000
        Meter: meter_id!, reading float 0..100000, read_at datetime
        Plant FEEDS Grid N:1 1/
        Meter ON_GRID Grid N:1 1/
        Grid LINKED_TO Grid N:M
        rule positive Plant: output > 0
        cycle Grid LINKED_TO Grid LINKED_TO Grid""",
    "water": """
        Well: well_id!, depth float 5..400, yield_ float 1..300
        Pump: pump_id!, power float 0.5..90, state on|off|broken, broken_on date if state = 'broken'
        Tank: tank_id!, volume float 10..9000, level float 0..10
        Pump LIFTS_FROM Well N:1 1/
        Pump FILLS_TANK Tank N:M
        Tank FLOWS_TO Tank N:M
        rule state only_broken_has_a_day Pump: state = 'broken' OR broken_on IS NULL
        rule reference lifted LIFTS_FROM: source
        cycle Tank FLOWS_TO Tank FLOWS_TO Tank""",
    "forestry": """
        Stand: stand_id!, hectares float 1..900, planted int 1850..2020
        Tree: tree_id!, species oak|beech|pine, height float 1..45, girth float 0.1..6, volume float = round(height * girth * girth / 12.566; 4)
        Ranger: ranger_id!, name, since date
        Tree GROWS_IN Stand N:1 1/
        Ranger WATCHES Stand N:M
        Stand BORDERS Stand N:M
        rule numeric volume_of_trunk Tree: abs(volume - height * girth * girth / 12.566) < 0.001
        rule reference rooted GROWS_IN: source
        cycle Stand BORDERS Stand BORDERS Stand""",
    "media": """
        Film: film_id!, title, year int 1920..2025, rating float 0..10
        Artist: artist_id!, name, born date
        Studio: studio_id!, name, city
        Artist PLAYS_IN Film N:M
        Studio MAKES Film 1:N /1
        Film SEQUEL_OF Film 1:1 1/1
        rule rated Film: rating BETWEEN 0 AND 10""",
    "music": """
        Band: band_id!, name, formed int 1950..2024
        Song: song_id!, title, seconds int 30..1200, plays int 0..900000, hours float = round(seconds * plays / 3600; 2)
        Festival: festival_id!, town, opens date, closes date after opens
        Band RECORDED Song 1:N /1
        Band PLAYS_AT Festival N:M
        Song SAMPLES Song N:M
        rule numeric hours_heard Song: abs(hours - seconds * plays / 3600) < 0.01
        rule temporal festival_runs Festival: closes >= opens
        cycle Song SAMPLES Song SAMPLES Song""",
    "news": """
        Paper: paper_id!, title, founded int 1700..2024
        Story: story_id!, headline, words int 40..9000, written datetime, state draft|printed, printed_at datetime if state = 'printed'
        Writer: writer_id!, name, beat city|sport|world
        Writer FILES_STORY Story 1:N /1
        Story PRINTED_IN Paper N:1 1/
        Story QUOTES Story N:M
        rule state drafts_have_no_print Story: state = 'printed' OR printed_at IS NULL
        rule reference printed PRINTED_IN: source
        cycle Story QUOTES Story QUOTES Story""",
}

#: Domain of each schema.
DOMAINS = {
    "finance": ("banking", "lending", "insurance"), "trade": ("retail", "wholesale", "auction"), "health": ("health", "pharmacy", "laboratory"),
    "education": ("education", "library", "research"), "travel": ("travel", "hotels", "railway"), "social": ("social", "messaging", "gaming"),
    "logistics": ("logistics", "shipping", "postal"), "software": ("software", "cloud", "releases"), "energy": ("energy", "water", "forestry"), "media": ("media", "music", "news"),
}
_KINDS = {"temporal": "temporal_consistency", "state": "state_consistency", "reference": "referential_integrity", "numeric": "numerical_consistency"}


def _property(text: str) -> Property:
    text, _, formula = text.partition(" = ") if " if " not in text else (text, "", "")
    text, _, only_if = text.partition(" if ")
    text, _, after = text.partition(" after ")
    words = text.split()
    name, unique = words[0].rstrip("!"), words[0].endswith("!")
    kinds = ("string", "int", "float", "boolean", "date", "datetime")
    kind = words[1] if len(words) > 1 and words[1] in kinds else "string"
    rest = [w for w in words[1:] if w not in kinds]
    low = high = None
    allowed: tuple = ()
    if rest and ".." in rest[0]:
        low, high = map(float, rest[0].split(".."))
    elif rest:
        allowed = tuple(rest[0].split("|"))
    # Properties are parted by commas, so a formula writes a semicolon for one.
    return Property(name, kind, not only_if, unique, low, high, allowed, formula.replace(";", ",") or None, after or None, only_if or None)


def parse_schema(name: str, source: str) -> GraphSchema:
    nodes, edges, rules, cycles = [], [], [], []
    for line in filter(None, map(str.strip, source.splitlines())):
        words = line.split()
        if words[0] == "rule":
            kind = _KINDS.get(words[1], "business_logic")
            title, where = words[1 + (words[1] in _KINDS) :][:2]
            edge = next((e for e in edges if e.name == where.rstrip(":")), None)
            rules.append(BusinessConstraint(title, kind, edge.source if edge else where.rstrip(":"), line.split(":", 1)[1].strip(), edge.name if edge else None))
        elif words[0] == "cycle":
            cycles.append(CyclePattern(f"{name}_{len(cycles)}", tuple(words[1:])))
        elif words[0].endswith(":"):
            nodes.append(NodeType(words[0][:-1], tuple(_property(p.strip()) for p in line.split(":", 1)[1].split(","))))
        else:
            caps = (words[4] if len(words) > 4 else "/").split("/")
            edges.append(RelationshipType(words[1], words[0], words[2], (Property("since", "date"),), words[3], *[int(c) if c else None for c in caps]))
    return GraphSchema(name, tuple(nodes), tuple(edges), tuple(rules), tuple(cycles))


SCHEMAS = {name: parse_schema(name, source) for name, source in SOURCES.items()}
