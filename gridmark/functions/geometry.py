"""Plane geometry of a pitch of 105 x 68 metres, origin at its centre, the attacked goal at x = 52.5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LENGTH, HALF_WIDTH, POST = 52.5, 34.0, 3.66
BOX_X, BOX_Y, NEAR_X, NEAR_Y, THIRD_X = 36.0, 20.16, 26.0, 25.0, 17.5


def unit_to_metres(x: Column, y: Column, y_down: bool = True) -> tuple[Column, Column]:
    """Positions in the unit square as metres."""
    return (x - 0.5) * 105, ((0.5 - y) if y_down else (y - 0.5)) * 68


def yards_to_metres(x: Column, y: Column) -> tuple[Column, Column]:
    """Positions on a 120 x 80 yard pitch as metres, anchored at the attacked goal."""
    return HALF_LENGTH - (120 - x) * 0.9144, (40 - y) * 0.9144


def turned(x: Column, y: Column, turn: Column) -> tuple[Column, Column]:
    """Rotated by 180 degrees where ``turn`` is true; null leaves them as they are."""
    sign = F.when(turn, -1.0).otherwise(1.0)
    return x * sign, y * sign


def flipped(team: Column, home_attacks_positive_x: Column) -> Column:
    """Whether a team attacks to the left; null without a team."""
    return (team == "home") != home_attacks_positive_x


def attack_sign(team: Column, home_attacks_positive_x: Column) -> Column:
    """1 if a team attacks to the right, -1 to the left, 0 without a team."""
    return F.coalesce(F.when(flipped(team, home_attacks_positive_x), -1).when(~flipped(team, home_attacks_positive_x), 1), F.lit(0))


def goal_distance(x: Column, y: Column) -> Column:
    return F.hypot(HALF_LENGTH - x, y)


def goal_angle(x: Column, y: Column) -> Column:
    """The angle between both posts; pi on the line between them."""
    dx, up, down = HALF_LENGTH - x, POST - y, -POST - y
    return F.atan2(F.abs(dx * down - dx * up), dx * dx + up * down)


def closing_speed(x: Column, y: Column, vx: Column, vy: Column) -> Column:
    """Speed towards the goal's centre; null in it."""
    return F.try_divide((HALF_LENGTH - x) * vx - y * vy, goal_distance(x, y))


def in_box(x: Column, y: Column) -> Column:
    return x.between(BOX_X, HALF_LENGTH) & (F.abs(y) <= BOX_Y)


def near_box(x: Column, y: Column) -> Column:
    return (x >= NEAR_X) & (F.abs(y) <= NEAR_Y)


def in_final_third(x: Column) -> Column:
    return x >= THIRD_X


def in_lane(px: Column, py: Column, bx: Column, by: Column) -> Column:
    """Whether a point lies in or on the triangle of the ball and both posts."""

    def cross(ax: Column, ay: Column, cx: Column, cy: Column) -> Column:
        return (cx - ax) * (py - ay) - (cy - ay) * (px - ax)

    gx, up, down = F.lit(HALF_LENGTH), F.lit(POST), F.lit(-POST)
    sides = [cross(bx, by, gx, up), cross(gx, up, gx, down), cross(gx, down, bx, by)]
    below = (sides[0] < 0) | (sides[1] < 0) | (sides[2] < 0)
    above = (sides[0] > 0) | (sides[1] > 0) | (sides[2] > 0)
    return ~(below & above)


def is_out(x: Column, y: Column) -> Column:
    return (F.abs(x) > HALF_LENGTH) | (F.abs(y) > HALF_WIDTH)


def at_restart_spot(x: Column, y: Column, within: float = 2.0) -> Column:
    """Near a corner, the centre spot or a penalty spot, or in a goal area."""
    ax, ay = F.abs(x), F.abs(y)
    corner = F.hypot(ax - HALF_LENGTH, ay - HALF_WIDTH) <= within
    centre, spot = F.hypot(x, y) <= within, F.hypot(ax - (HALF_LENGTH - 11.0), y) <= within
    return corner | centre | spot | ((ax >= HALF_LENGTH - 5.5) & (ay <= 9.16))


def in_penalty_area(x: Column, y: Column) -> Column:
    return (F.abs(x) >= BOX_X) & (F.abs(y) <= BOX_Y)


def projected(x: Column, y: Column, m: list[Column]) -> tuple[Column, Column]:
    """A point through a 3 x 3 matrix given row by row; null where it has no image."""
    w = m[6] * x + m[7] * y + m[8]
    return F.try_divide(m[0] * x + m[1] * y + m[2], w), F.try_divide(m[3] * x + m[4] * y + m[5], w)


def pinhole(x: Column, y: Column, z: Column, r: list[Column], t: list[Column], focal: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pixel coordinates of a point through a camera (rotation by rows, translation); null behind it."""
    u, v, depth = (r[3 * i] * x + r[3 * i + 1] * y + r[3 * i + 2] * z + t[i] for i in range(3))
    ahead = F.when(depth > 0, depth)
    return focal * u / ahead + cx, focal * v / ahead + cy


def expected_width(x: Column, y: Column, forward: list[Column], back: list[Column], radius: float = 0.11) -> Column:
    """The pixels that 2 x radius metres around an image point span."""
    mx, my = projected(x, y, forward)
    (ax, ay), (bx, by) = projected(mx - radius, my, back), projected(mx + radius, my, back)
    return F.hypot(bx - ax, by - ay)


def on_screen(airborne: Column, detected: Column, left: Column, top: Column, right: Column, bottom: Column, width: int, height: int) -> Column:
    """Airborne objects aren't; detected ones are; a filled-in box must overlap the image."""
    overlaps = (right > 0) & (bottom > 0) & (left < width) & (top < height)
    return F.when(airborne, False).when(detected, True).otherwise(F.coalesce(overlaps, F.lit(False)))
