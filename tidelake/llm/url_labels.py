"""The small labelled URL table: made-up hosts of both kinds, kept apart from the pages that are judged.

The unwanted ones are named in the general words of block lists (gambling, medicine, adult, money, fakes,
advertising and tracking, spam, malware), the wanted ones in those of everyday sites, some of which hold an
unwanted word by chance (pillow, essex, shadows). Subdomains, domains and plain paths are dealt alike to both.
Paths of either kind, in the same general words, come with plain hosts, so that paths are told apart by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNWANTED = """
luckycasino casino-royal bestcasino pokerroom online-poker poker-bonus slot-machine megaslots slots-jackpot jackpot-city bingo-bonus
sportsbet betting-tips live-bets betnow bookmaker-bets roulette-live lottery-winner winbig gamble-online viagra-shop buyviagra
cialis-online pills-online dietpills cheapmeds discount-pills pharma-pills rx-meds weightloss-pills steroids-shop tramadol-cheap
porn-videos freeporn xxx-tube xxxcams sexcams sex-dating hot-adult adult-dating adultvideos nude-cams escort-girls milf-tube camgirls
erotic-chat payday-loan fastloans loan-cash quick-cash easymoney get-rich crypto-double bitcoin-profit free-iphone free-prizes
giftcard-free prize-winner claim-reward freemoney replica-watches cheap-replica fake-rolex cheap-handbags essay-mill buy-followers
adserver ads-network popads adclick clicktrack track-pixel tracker-ads banner-ads adtracking pixel-tracker popunder-ads linkfarm
seo-links backlinks-cheap spamlinks spam-mailer bulk-spam mass-mailer email-spam phishing-login login-verify crack-keygen warez-crack
keygen-download torrent-warez malware-host trojan-download free-cracks serial-keys
""".split()
WANTED = """
library cityschool garden-club weather history-museum recipes cooking-notes travel-guide mountain-hiking river-news daily-herald
evening-post science-journal physics-dept math-forum chess-club book-reviews poetry music-school orchestra film-archive theatre
art-gallery photo-notes bird-watch farmers-market track-and-field train-times bus-routes airport harbour ocean-lab climate-data
open-maps street-map town-hall county-court parliament law-review health-clinic hospital nursing dental-care pharmacy-school
medicine-today nutrition fitness running cycling football-club tennis swimming sailing parenting kids-games toys puzzles crafts
knitting woodwork home-repair architecture engineering robotics software-docs python-notes linux-wiki database-blog network-lab
security-blog hardware-reviews phone-reviews car-magazine motor-news savings-bank insurance tax-advice economy-watch business-week
job-board career-guide university college students teachers language-courses dictionary translation grammar encyclopedia genealogy
church charity volunteers animal-shelter pets dogs horses flowers forestry geology astronomy space-news telescope adventure loanwords
betterhomes essex-times middlesex-college pillow-store assets badminton winter-sports windows-help cashew-recipes adelaide-news shadows
therapy weathering gathering station-house national fashion mission british danish finish fishing workshop publishing furnishing
friendship membership scholarship partnership edition tradition nutritionist nations solutions relations questions collection
election construction education vacation foundation association federation institute society council community country county
northern southern western eastern brother father mother another together whether either leather feather southern-living north-star
thread thought theme thesis method anthem ethics mathematics athletics authors earth health-news youth truth growth month
tablet table-tennis vegetable notable sustainable portable bubble people apple-orchard simple temple candle bottle castle
enterprise interest internet winter-garden printer painter writer reader leader teacher-union speaker builder holder border
order under wonder thunder render vendor standard island england ireland scotland holland poland finland
""".split()
UNWANTED_PATHS = """
casino/bonus casino/slots poker/bonus slots/free-spins bet/odds-live betting/bonus jackpot/win win/free-prize prize/claim
claim/free-gift free/giftcard free/iphone adult/videos adult/cams xxx/videos xxx/free porn/videos porn/free-cams sex/chat sex/cams
viagra/buy viagra/cheap cialis/cheap pills/buy-cheap pills/diet meds/cheap loan/fast-cash loan/payday cash/easy crypto/double
crack/keygen keygen/download warez/crack replica/watches replica/cheap ads/click ads/banner track/click popunder/ads spam/links
""".split()
WANTED_PATHS = """
articles/history articles/science docs/install-guide docs/reference guide/travel recipes/soup recipes/bread news/local news/weather
about/team contact/office library/catalogue library/opening-hours courses/mathematics courses/physics museum/exhibition
museum/tickets timetable/trains maps/city reviews/books reviews/films garden/plants health/advice sports/results sports/fixtures
jobs/teachers research/papers archive/letters
""".split()
PLAIN_HOSTS = ("www.example.com", "example.org", "pages.example.com")
SUBDOMAINS = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.net", "example.org")
PATHS = ("/en/1", "/de/2.html", "/fr/3/", "/es/4", "/news/5", "/")


def url_labels(keep=lambda place: True) -> list[tuple[str, int]]:
    """(url, label); 1: block. Each name has a row with each subdomain. keep: of names by their place among their kind."""
    return [(f"http://{sub}{name}.{DOMAINS[(k + j) % 3]}{PATHS[(k // 3 + j) % 6]}", y)
            for y, names in ((0, WANTED), (1, UNWANTED)) for k, name in enumerate(names) if keep(k) for j, sub in enumerate(SUBDOMAINS)]


def path_labels(keep=lambda place: True) -> list[tuple[str, int]]:
    """(url, label) of paths with plain hosts; keep: of paths by their place among their kind. The wanted ones come with each host, the
    unwanted ones with one, as the fit gives both kinds the same weight and has half as many unwanted rows: the hosts tell nothing."""
    places = list(zip(PLAIN_HOSTS, ("", "/", ".html")))
    return [(f"http://{host}/{path}{end}", y) for y, paths in ((0, WANTED_PATHS), (1, UNWANTED_PATHS)) for k, path in enumerate(paths) if keep(k)
            for j, (host, end) in enumerate(places) if y == 0 or j == k % 3]


def labelled(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> DataFrame:
    rows = url_labels() + path_labels() if rows is None else rows
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in rows) + " AS t(url, label)")
