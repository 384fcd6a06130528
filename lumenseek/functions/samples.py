"""Small sources in each language, and the names in them: read by eye, not by the extractors.

A "7" in a name stands for a key, so that a source can be made for each row of a table. A name's line says: its line, its
column, its kind (d definition, r reference, or a word of its own), the name, and its namespace if it has one.
"""

SAMPLES: dict[str, tuple[str, str]] = {
    "lua": (
        """\
local count7 = 1
function area7(w, h)
  return w * h
end
shape7 = { side = count7 }
""",
        """\
1 7 variable_definition count7
2 10 function_definition area7
2 16 parameter_definition w area7
2 19 parameter_definition h area7
3 10 r w area7
3 14 r h area7
5 1 variable_definition shape7
5 12 table_field_definition side
5 19 r count7
""",
    ),
    "c": (
        """\
#include <stdio.h>
struct Point7 {
  int x7;
};
int area7(int w, int h) {
  int r = w * h;
  return r;
}
""",
        """\
2 8 d Point7
3 7 d x7 Point7
5 5 d area7
5 15 d w area7
5 22 d h area7
6 7 d r area7
6 11 r w area7
6 15 r h area7
7 10 r r area7
""",
    ),
    "cpp": (
        """\
namespace Geo7 {
class Shape7 {
 public:
  int area7(int w) const { return w; }
};
}
""",
        """\
1 11 d Geo7
2 7 d Shape7 Geo7
4 7 d area7 Geo7::Shape7
4 17 d w Geo7::Shape7::area7
4 35 r w Geo7::Shape7::area7
""",
    ),
    "go": (
        """\
package geo7

type Shape7 struct {
	Side int
}

func (s Shape7) Area7() int {
	n := s.Side
	return n
}
""",
        """\
1 9 d geo7
3 6 d Shape7 geo7
4 2 d Side geo7.Shape7
7 7 d s geo7.Shape7.Area7
7 17 d Area7 geo7.Shape7
8 2 d n geo7.Shape7.Area7
8 7 r s geo7.Shape7.Area7
8 9 r Side geo7.Shape7.Area7
9 9 r n geo7.Shape7.Area7
""",
    ),
    "js": (
        """\
class Shape7 {
  area7(w) {
    return w;
  }
}
const side7 = 4;
function make7(a) {
  return new Shape7(a);
}
""",
        """\
1 7 d Shape7
2 3 d area7 Shape7
2 9 d w Shape7.area7
3 12 r w Shape7.area7
6 7 d side7
7 10 d make7
7 16 d a make7
8 14 r Shape7 make7
8 21 r a make7
""",
    ),
    "java": (
        """\
package geo;

public class Shape7 {
  private int side7;
  public int area7(int w) {
    return w * side7;
  }
}
""",
        """\
3 14 d Shape7 geo
4 15 d side7 geo.Shape7
5 14 d area7 geo.Shape7
5 24 d w geo.Shape7.area7
6 12 r w geo.Shape7.area7
6 16 r side7 geo.Shape7.area7
""",
    ),
    "nix": (
        """\
{ pkgs, size7 }:
let
  side7 = size7;
in {
  area7 = side7;
}
""",
        """\
1 3 r pkgs
1 9 r size7
3 3 d side7
3 11 r size7
5 3 d area7
5 11 r side7
""",
    ),
    "objc": (
        """\
@interface Shape7 : NSObject
@property int side7;
- (int)area7:(int)w;
@end
@implementation Shape7
- (int)area7:(int)w {
  return w;
}
@end
""",
        """\
1 12 d Shape7
1 21 r NSObject Shape7
2 15 d side7 Shape7
3 8 d area7 Shape7
3 19 d w Shape7.area7
5 17 d Shape7
6 8 d area7 Shape7
6 19 d w Shape7.area7
7 10 r w Shape7.area7
""",
    ),
    "php": (
        """\
<?php
namespace Geo7;
class Shape7 {
  private $side7;
  function area7($w) {
    return $w;
  }
}
""",
        """\
3 7 d Shape7 Geo7
4 12 d side7 Geo7\\Shape7
5 12 d area7 Geo7\\Shape7
5 19 d w Geo7\\Shape7\\area7
6 13 r w Geo7\\Shape7\\area7
""",
    ),
    "proto": (
        """\
syntax = "proto3";
package geo7;
message Shape7 {
  int32 side7 = 1;
}
service Maker7 {
  rpc Make7(Shape7) returns (Shape7);
}
""",
        """\
2 9 d geo7
3 9 d Shape7 geo7
4 9 r side7 geo7.Shape7
6 9 d Maker7 geo7
7 7 d Make7 geo7.Maker7
7 13 r Shape7 geo7.Maker7
7 30 r Shape7 geo7.Maker7
""",
    ),
    "rust": (
        """\
mod geo7 {
    pub struct Shape7 {
        side7: u32,
    }
    impl Shape7 {
        pub fn area7(&self, w: u32) -> u32 {
            w * self.side7
        }
    }
}
""",
        """\
1 5 d geo7
2 16 d Shape7 geo7
3 9 d side7 geo7::Shape7
5 10 r Shape7 geo7
6 16 d area7 geo7::Shape7
6 29 d w geo7::Shape7::area7
7 13 r w geo7::Shape7::area7
7 22 r side7 geo7::Shape7::area7
""",
    ),
    "swift": (
        """\
class Shape7 {
  var side7: Int = 0
  func area7(w: Int) -> Int {
    return w * side7
  }
}
""",
        """\
1 7 d Shape7
2 7 d side7 Shape7
2 14 r Int Shape7
3 8 d area7 Shape7
3 14 d w Shape7.area7
3 25 r Int Shape7
4 12 r w Shape7.area7
4 16 r side7 Shape7.area7
""",
    ),
    "ts": (
        """\
interface Sized7 {
  side7: number;
}
class Shape7 implements Sized7 {
  side7 = 4;
  area7(w: number): number {
    return w;
  }
}
""",
        """\
1 11 d Sized7
2 3 d side7 Sized7
4 7 d Shape7
4 25 r Sized7
5 3 d side7 Shape7
6 3 d area7 Shape7
6 9 d w Shape7.area7
7 12 r w Shape7.area7
""",
    ),
    "glsl": (
        """\
uniform vec3 light7;
struct Ray7 {
  vec3 origin7;
};
float area7(float w) {
  return w;
}
""",
        """\
1 14 d light7
2 8 d Ray7
3 8 d origin7 Ray7
5 7 d area7
5 19 d w area7
6 10 r w area7
""",
    ),
}
