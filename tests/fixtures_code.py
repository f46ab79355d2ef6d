"""Small functions on ledgers and readings in five languages, and variants of some of them.

``largest_step`` and ``steepest`` are one function under two sets of names, with the first two statements the other way round.
``charge`` is the first loop of ``settle``. ``label`` is like none of them.
"""

PYTHON = '''
def largest_step(readings):
    """The widest jump from a reading to the next."""
    widest = 0
    last = None
    for value in readings:
        if last is not None:
            jump = abs(value - last)
            if jump > widest:
                widest = jump
        last = value
    return widest


def settle(accounts, fee, limit):
    closed = []
    for account in accounts:
        account.balance = account.balance - fee
        if account.balance < 0:
            account.frozen = True
    for account in accounts:
        if account.age > limit:
            closed.append(account.owner)
    return closed


def label(codes, table):
    text = []
    for code in codes:
        name = table.get(code, "unknown")
        text.append(name.upper())
    return "/".join(text)
'''
PYTHON_B = '''
def steepest(heights):
    before = None
    best = 0
    for h in heights:
        if before is not None:
            climb = abs(h - before)
            if climb > best:
                best = climb
        before = h
    return best


def charge(rows, cost):
    for row in rows:
        row.balance = row.balance - cost
        if row.balance < 0:
            row.frozen = True
'''
RUST = """
pub fn largest_step(readings: &[i64], start: i64) -> i64 {
    let mut widest = 0i64;
    let mut last = start;
    for value in readings {
        let jump = (value - last).abs();
        if jump > widest { widest = jump; }
        last = *value;
    }
    widest
}
impl Ledger {
    fn settle(&mut self, fee: i64, limit: u32) -> Result<Vec<String>, String> {
        let rate = match self.plan { Plan::Flat(r) => r, _ => return Err(format!("no rate above {}", limit)) };
        for account in self.accounts.iter_mut() {
            account.balance -= fee * rate;
            if account.balance < 0 { account.frozen = true; }
        }
        let closed = self.accounts.iter().filter(|a| a.age > limit).map(|a| a.owner.clone()).collect::<Vec<_>>();
        Ok(closed)
    }
}
"""
RUST_B = """
fn steepest(heights: &[i64], floor: i64) -> i64 {
    let mut before = floor;
    let mut best = 0i64;
    for h in heights {
        let climb = (h - before).abs();
        if climb > best { best = climb; }
        before = *h;
    }
    best
}
"""
GO = """package ledger
func LargestStep(readings []int, start int) int {
	widest := 0
	last := start
	for _, value := range readings {
		jump := distance(value, last)
		if jump > widest {
			widest = jump
		}
		last = value
	}
	return widest
}
func (l *Ledger) Route(owner string) (int, error) {
	if desk, ok := l.desks[owner]; ok {
		return desk, nil
	}
	for n := 0; n < len(l.queues); n++ {
		switch l.queues[n].state {
		case 3, 4:
			return n, nil
		default:
			continue
		}
	}
	return 0, errors.New("no desk")
}
"""
GO_B = """package hills
func Steepest(heights []int, floor int) int {
	before := floor
	best := 0
	for _, h := range heights {
		climb := distance(h, before)
		if climb > best {
			best = climb
		}
		before = h
	}
	return best
}
"""
JS = """
function largestStep(readings, start) {
  let widest = 0;
  let last = start;
  for (const value of readings) {
    const jump = Math.abs(value - last);
    if (jump > widest) { widest = jump; }
    last = value;
  }
  return widest;
}
const owed = (rows, rate = 2) => rows.map(r => r.due * rate).filter(x => x > 10);
class Ledger {
  async open(path) {
    try { this.rows = await fetch(`${path}/rows`); } catch (e) { throw new Error("closed " + path); }
    return { count: this.rows.length, at: path };
  }
}
"""
JS_B = """
function steepest(heights, floor) {
  let before = floor;
  let best = 0;
  for (const h of heights) {
    const climb = Math.abs(h - before);
    if (climb > best) { best = climb; }
    before = h;
  }
  return best;
}
"""
C = """
#include <stdlib.h>
static int largest_step(const int *readings, int size) {
  int widest = 0;
  for (int i = 1; i < size; i++) {
    int jump = abs(readings[i] - readings[i - 1]);
    widest = jump > widest ? jump : widest;
  }
  return widest;
}
int freeze(struct ledger *book, int limit) {
  struct account *at = book->first;
  int frozen = 0;
  while (at != NULL) {
    if (at->balance < limit) { at->frozen = 1; frozen++; }
    at = at->next;
  }
  return frozen;
}
"""
OCAML = """
let largest_step readings start =
  let widest = ref 0 in
  let last = ref start in
  List.iter (fun value ->
    let jump = abs (value - !last) in
    if jump > !widest then widest := jump;
    last := value) readings;
  !widest

let rec total rows = match rows with
  | [] -> 0
  | row :: rest -> row.balance + total rest
"""
OCAML_B = """
let steepest heights floor =
  let before = ref floor in
  let best = ref 0 in
  List.iter (fun h ->
    let climb = abs (h - !before) in
    if climb > !best then best := climb;
    before := h) heights;
  !best
"""
